"""Schemas of the records that the operators exchange, as DDL text."""

from __future__ import annotations

ARTICLE = (
    "id string, title string, summary string, link string, published_at timestamp_ntz, source_name string, source_ord int, entry_ord int, theme string, class_phase int"
)
SOURCE = ("ord int, name string, url string, type string, category string")
THEME_KEYWORD = ("theme_ord int, theme string, color string, color_hex string, colormap string, kw_ord int, keyword string")
FEED_ENTRY = (
    "source_name string, entry_ord int, title string, summary string, description string, link string, published_parsed timestamp_ntz, updated_parsed timestamp_ntz, dc_date string, published string, updated string"
)
PAGE = ("source_name string, url string, html string")
REPLY = ("batch_id bigint, reply string, status int, error string")
SUMMARY = ("theme string, what_is_happening string, why_it_matters string, what_to_watch string, further_reading string")
