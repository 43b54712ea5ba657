"""Schemas of the records the engine reads and writes."""

OFFER = "struct<kind:string,matched:string,vendor:string,product:string,evidence:string>"
DEAL = (
    "fingerprint string, url string, title string, summary string, source string, category string, "
    f"offers array<{OFFER}>, vendors array<string>, tags array<string>, is_free boolean, discount_pct int, score int, "
    "score_why array<string>, published_at timestamp, discovered_at timestamp, meta map<string,string>"
)
STATE = "key string, value string, updated_at timestamp"
REMINDED = "fingerprint string, at timestamp"
