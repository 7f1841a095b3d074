"""Schemas of the inputs and outputs; nothing is inferred from data."""

from __future__ import annotations

IMAGE = "struct<id:string,url:string,alt:string,caption:string,position:int>"
PLACED = "struct<id:string,url:string,position:int,score:double>"
ARTICLE = "struct<url:string,date:string,title:string,content:string,images:array<string>>"
ARTICLES = "article_id string, url string, date string, title string, content string, images array<string>"
EMBEDDINGS = "id string, embedding array<float>"
HITS = "query_id string, item_id string, score double, rank int"
STATS = "struct<query_id:string,entropy:double,gap:double,low_top1_sim:double>"
CRAWLED = f"struct<key:string,url:string,crawl_date:string,title:string,publish_date:string,section:string,category:string,author:string,meta_description:string,keywords:array<string>,content:string,images:array<{IMAGE}>,word_count:int,reading_time_minutes:double,named_entities:array<string>,event_date:string,event_location:string>"
MATCHING = "map<string,struct<filename:string,score:double>>"
REBUILT = f"struct<url:string,date:string,title:string,category:string,author:string,meta_description:string,keywords:array<string>,word_count:int,reading_time_minutes:double,images:array<{PLACED}>,content:string>"
CONTEXT = "struct<query_id:string,image_id:string,article_id:string,article_url:string>"
SUMMARY = "struct<article_id:string,summary:string>"
RESULT = "struct<query_id:string,crawl_alt:string,crawl_caption:string,article:string,article_position:int,image_url:string,article_url:string,image_id:string,article_id:string>"


def retrieval(k: int = 15, prefix: str = "image_id") -> str:
    return ", ".join(["query_id string", *(f"{prefix}_{i} string" for i in range(1, k + 1)), "generated_caption string"])
