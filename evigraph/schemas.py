"""Logical tables of the engine as Spark schemas."""

from __future__ import annotations

SOURCE_DOC = "source_type string, source_id string, title string, text string, text_ja string, chunks array<string>, metadata map<string,string>, created_at string"
CHUNK = "source string, chunk_idx long, offset int, text string"
CLAIM = "doc_id string, claim_idx int, claim string"
VERIFICATION = "claim string, verdict string, reason string, evidence array<string>"
ENTITY = "name string, type string, description string, confidence double, source_id string"
TRIPLE = "subject string, predicate string, object string, confidence double, source_id string"
PROCESSED_DOC = "source_id string, summary string, score double, summary_path string"
REGISTRY = "source_type string, source_id string, title string, status string, error string, graph_written int, added_at string, processed_at string"
BLOCK = "id string, type string, en string, ja string, level int, section_path array<string>, page int, bbox array<double>, image_path string, label string, skip_translate boolean"
RAW_BLOCK = "kind string, page int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, bold boolean, image_bytes binary, image_ext string"
SEGMENT = "start double, end double, text string"
TURN = "start double, end double, speaker string"
CHAPTER = "book string, src_idx int, num string, title string, part string"
FEED_ENTRY = "id string, title string, published timestamp, channel string, categories array<string>, authors array<string>"
EPISODE = "ep_num int, pub_date string, title string, audio_url string, duration string, description string, status string, file_path string, error string"
COMMENT = "id string, author string, text string, votes int, reply_count int, score int, time string"
LINK_CACHE = "query string, canonical_name string, url string, qid string, confidence double, method string, fetched_at string"

# Controlled vocabularies.
STATUSES = ("pending", "processing", "done", "failed")
VERDICTS = ("supported", "partial", "contradicted", "unverifiable")
