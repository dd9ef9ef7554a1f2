"""Event objects embedded in HTML pages as pushed script chunks."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame

from matchloom.session import spread

PUSH = re.compile(r"self\.__next_f\.push\(\s*")
SCHEMA = "page_id long, event_id long, json string, error string"


def _embedded(html: str, event_id: int) -> tuple[str | None, str | None]:
    decoder, chunks = json.JSONDecoder(), []
    for found in PUSH.finditer(html):
        try:
            payload, _end = decoder.raw_decode(html, found.end())
        except ValueError:
            return None, "invalid_chunk"
        if isinstance(payload, list) and payload[:1] == [1] and len(payload) > 1 and isinstance(payload[1], str):
            chunks.append(payload[1])
    text = "".join(chunks) or html
    spot = re.search(r'\{\s*"id"\s*:\s*%d\s*,' % event_id, text)
    if spot is None:
        return None, "not_found"
    try:
        value, end = decoder.raw_decode(text, spot.start())
    except ValueError:
        return None, "invalid_object"
    if value.get("id") != event_id:
        return None, "wrong_event"
    return text[spot.start():end], None


def extract_embedded_json(pages: DataFrame) -> DataFrame:
    """(page_id, event_id, html) to the event's JSON text or an error, one row per page.

    Chunks are decoded once per JSON layer and joined before the object is looked for, so an
    object may span chunks. Bad pages are kept with their reason.
    """
    def run(batches):
        for frame in batches:
            out = [_embedded(h or "", int(i)) for h, i in zip(frame["html"], frame["event_id"])]
            yield pd.DataFrame({
                "page_id": frame["page_id"], "event_id": frame["event_id"],
                "json": [o[0] for o in out], "error": [o[1] for o in out]})
    return spread(pages.select("page_id", "event_id", "html"), "page_id").mapInPandas(run, SCHEMA)
