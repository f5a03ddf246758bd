"""Queries over rows of any script and every format, against brute force."""

import re
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from graphloom.functions.text import HONORIFICS, TITLES


def run(spark, tmp_path, table, rows, name):
    pq.write_table(pa.Table.from_pylist(rows), f"{tmp_path}/{table}.parquet")
    return {tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()}


NAMES = ["Dr. José  Núñez", "Shri Anil “Tiger” Rao", "Ms. Anna Lee", None, "Łukasz—Kowalski"]


def test_names(spark, tmp_path):
    rows = [{"person_id": f"p{i}", "name": n} for i, n in enumerate(NAMES)]
    squeeze = lambda x: re.sub(r"\s+", " ", x, flags=re.A).strip()
    low = {f"p{i}": n.strip().lower() for i, n in enumerate(NAMES) if n}
    want = {(k, squeeze(re.sub("[^a-z0-9 ]", " ", re.sub(rf"\b({'|'.join(HONORIFICS)})\b", " ", n)))) for k, n in low.items()}
    assert run(spark, tmp_path, "person_records", rows, "name_normalise") == want and len(want) == 4
    want = {(k, squeeze(re.sub(rf"\b({'|'.join(TITLES)})\.?\s*", "", n))) for k, n in low.items()}
    assert run(spark, tmp_path, "person_records", rows, "eval_normalise") == want


def test_html(spark, tmp_path):
    texts = ["plain  text", "café – <b>bold</b>\nnext", "", None]
    want = {(i, len(re.sub(r"\s+", " ", re.sub("[<>]", "", x)).strip())) for i, x in enumerate(texts) if x is not None}
    assert run(spark, tmp_path, "documents", [{"doc_id": i, "text": x} for i, x in enumerate(texts)], "html_strip") == want


def test_every_format_and_none(spark, tmp_path):
    formats = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d %B %Y", "%B %Y", "%Y")
    texts = ["2018-01-06T04:44:47", "2018-01-02 23:15:58", "2018-01-02 23:15", "2018-01-02", "03 March 2019", "March 2020", "2021", "01/01/20 20:41", "evening", "", None]

    def first(x):
        for f in formats:
            try:
                return datetime.strptime(x or "", f)
            except ValueError:
                pass
        return None

    want = {(f"e{i}", first(x)) for i, x in enumerate(texts)}
    assert run(spark, tmp_path, "time_events", [{"event_id": f"e{i}", "timestamp": x} for i, x in enumerate(texts)], "timestamp_ladder") == want
