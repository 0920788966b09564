"""Schemas of the collections, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTACT = ("struct<type:string,value:string,confidence:double,source:string,verified:boolean,is_primary:boolean,"
           "found_at:timestamp,metadata:map<string,string>>")
SOCIAL = "struct<platform:string,url:string,source:string,verified:boolean>"

TABLES = {
    "company": f"id long, user_id string, domain string, company_name string, description string, smykm_notes array<string>, "
               f"contacts array<{CONTACT}>, social_media array<{SOCIAL}>, contact_score string, search_mode string, "
               "email_verification map<string,struct<is_valid:boolean>>, relevance_status string, relevance_reason string, "
               "crawl_status string, crawl_progress int, crawled_pages int, crawled_at timestamp, extracted_at timestamp, "
               "enriched_at timestamp, embedded_at timestamp, created_at timestamp, updated_at timestamp",
    "product": "company_id long, domain string, seq long, product_external_id string, name string, brand string, "
               "category string, price string, url string, image_url string, description string, specs map<string,string>, "
               "reviews array<string>, created_at timestamp",
    "discovered_domain": "domain string, query_id long, engine string, query string, discovered_at timestamp",
    "query_cache": "engine string, query string, domains array<string>, completed_at timestamp",
    "vetting_result": "domain string, has_product_schema boolean, has_cart boolean, has_platform_fp boolean, "
                      "decision string, vetted_at timestamp",
    "crawled_page": "page_id long, domain string, url string, title string, content string, content_hash string, depth int, "
                    "crawled_at timestamp",
    "page_link": "from_url string, url string, pos int",
    "crawl_state": "domain string, visited_urls array<string>, visited_hashes array<string>, is_complete boolean, "
                   "pages_crawled int, started_at timestamp, completed_at timestamp",
    "homepage_features": "domain string, seq long, features struct<company_name:string,title:string,description:string,"
                         "emails:array<string>,social:map<string,string>>",
    "search_result": "seq long, domain string, url string, title string, snippet string, source string, query string",
    "enrichment_result": f"domain string, contacts array<{CONTACT}>, social_media map<string,string>, "
                         "sources_checked array<string>, search_mode string, contact_score string, notes string, "
                         "enriched_at timestamp",
    "chunk_profile": "domain string, seq long, company string, description string, notes array<string>, main_contacts "
                     "struct<email:array<string>,phone:array<string>,address:array<string>,contact_page:string>, "
                     "social_media map<string,string>",
    "campaign": "id long, user_id string, name string, status string, stats map<string,int>, created_at timestamp",
    "email_draft": "id long, company_id long, domain string, campaign_id string, user_id string, status string, "
                   "subject string, body string, to_emails array<string>, created_at timestamp, updated_at timestamp",
    "email_check": "email string, mx_found boolean, smtp_result boolean, verified_at timestamp",
    "list_entry": "email string, reason string, domain string, ts timestamp",
    "send_log": "message_id string, domain string, recipient string, subject_line string, campaign_id string, status string, "
                "error string, sent_at timestamp, email_length int",
    "rag_embedding": "chunk_id string, domain string, collection_name string, content string, embedding array<float>, "
                     "content_hash string, tokens int, url string, title string, metadata map<string,string>, "
                     "embedded_at timestamp",
    "rag_query": "query string, answer string, confidence double, asked_at timestamp",
    "job": "id long, user_id long, job_type string, status string, progress int, config string, result string, error string, "
           "created_at timestamp, started_at timestamp, completed_at timestamp",
    "domain_alias": "owner string, primary_domain string, alias_domain string, confidence double, source string",
    "enrichment_history": "company_id long, event string, created_at timestamp",
    "event_message": "event string, data string, user_id string, team_id string, timestamp timestamp",
    "connection_event": "user_id string, connection_id string, action string, ts timestamp",
    "robots_rule": "host string, agent string, rule string, prefix string",
}


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored collection with its full schema; columns added later read as null from older files."""
    return spark.read.schema(TABLES[name]).parquet(path)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
