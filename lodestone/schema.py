"""Schemas of the index tables; nothing is inferred."""

from __future__ import annotations

ATTRIBUTE = "struct<attr_id:string,title:string,value_id:string,value:string,pos:int>"
DOCUMENTS = (
    "id string, shop_id int, lang_id int, article_id string, parent_id string, group_id string, visible boolean, title string, artnum string, ean string, mpn string,"
    " brand string, manufacturer_id string, category_paths array<string>, category_ids array<string>,"
    f" attributes array<{ATTRIBUTE}>, search_text string, boost_text string, search_tokens array<string>, boost_tokens array<string>,"
    " price decimal(9,2), stock double, sold int, insert_date timestamp_ntz"
)
ROLLUP = "shop_id int, lang_id int, group_id string, attr_id string, value_id string, value string"
CATEGORY_LINKS = "shop_id int, lang_id int, group_id string, cat_id string"
POSTINGS = "shop_id int, lang_id int, field string, token string, id string, tf long, positions array<int>"
GRAMS = "shop_id int, lang_id int, gram string, id string"
SIZES = "shop_id int, lang_id int, documents long"
CELLS = "shop_id int, lang_id int, id string, group_id string, visible boolean, manufacturer_id string, price decimal(9,2), attributes array<struct<attr_id:string,value_id:string,value:string>>, word long, mask long"
WORDS = "shop_id int, lang_id int, attr_id string, value_id string, value string, word long, mask long"
DICTIONARY = "shop_id int, lang_id int, term string, term_raw string, bucket string, phonetic string, length int, frequency long, source string"
SEARCH_EVENT = "shop_id int, lang_id int, ts timestamp, request_id string, term_raw string, hits int, corrected string, first_look boolean"
SEARCH_LOG = "shop_id int, lang_id int, day date, term string, term_raw string, searches long, hits int, corrected string, last_seen timestamp"
SYNONYMS = "shop_id int, lang_id int, kind string, term string, synonyms string, active boolean, sort int"
ATTRIBUTE_CONFIG = "shop_id int, attr_id string, facet boolean, searchable boolean, display string, sort int"
ATTRIBUTE_TITLES = "shop_id int, attr_id string, lang_id int, title string"
