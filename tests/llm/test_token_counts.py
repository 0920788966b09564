import random

import numpy as np

from orgweave.llm import token_counts as T
from tests.llm.conftest import DOCS, words


def plain_counts(ids, end):
    out, n = [], 0
    for i in ids:
        if i == end:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


def test_boundaries_over_blocks(spark, tmp_path):
    rng = random.Random(15)
    want = {}
    for k, ids in enumerate([
            [rng.choice([9, 1, 2, 3]) for _ in range(997)], [1] * 500, [9] * 77, [9], [], [1] * 300 + [9] + [2] * 5,
            [1, 9] * 64]):
        (tmp_path / f"{k}.bin").write_bytes(np.array(ids, dtype="<u4").tobytes())
        want[f"{k}.bin"] = plain_counts(ids, 9)
    files = T.token_files(spark, str(tmp_path))
    for block in (8, 64, 4096):
        got = {}
        for r in T.count_tokens(files, 9, "<u4", block).orderBy("ordinal").collect():
            got.setdefault(r.file.rpartition("/")[2], []).append((r.ordinal, r.n_tokens, r.closed))
        assert got == {f: [(i, *x) for i, x in enumerate(v)] for f, v in want.items() if v}


def test_counts_of_documents(spark):
    from tokenizers import Tokenizer
    from orgweave.llm.tokens import tokenizer_path
    coder = Tokenizer.from_file(tokenizer_path())
    coder.encode_special_tokens = True
    rng = random.Random(16)
    rows = [(i, words(rng, rng.randrange(0, 90)), "en", "s", 1) for i in range(150)] + [(900, "a <|endoftext|> b", "en", "s", 1)]
    got = {r.doc_id: r.n_tokens for r in T.document_counts(spark.createDataFrame(rows, DOCS), block_bytes=256).collect()}
    assert got == {i: len(coder.encode(t, add_special_tokens=False).ids) for i, t, *_ in rows}


def test_odd_input(odd, empty, crowded):
    for df in (odd, crowded):
        got = T.document_counts(df).collect()
        assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (1, 2, 5)} == {0}
    assert T.document_counts(empty).count() == 0
