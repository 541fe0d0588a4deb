"""Ids of other types than numbers, and columns with odd names."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from derivata.llm import bpe, chat, tokenfile
from derivata.llm.cluster import new_path
from derivata.shipping import ship


def test_token_files_keep_ids_of_any_type(spark):
    ship(spark)
    rows = [("b", "two words"), ("a", None), ("ü.1", "x" * 50), (None, "none")]
    folder = new_path(spark, "ids")
    tokenfile.write_tokens(spark.createDataFrame(rows, "`an.id` string, `the text` string"), folder, "an.id", "the text")
    got = {r.doc_id: r for r in tokenfile.read_tokens(spark, folder, digests=True).collect()}
    library, start = bpe.library(bpe.default_path()), 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, tokenfile.END_ID]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_conversations_keep_ids_of_any_type(spark):
    rows = [("k.2", 1, "assistant", "b"), ("k.2", 0, "user", "a"), ("k", 0, "user", None)]
    table = spark.createDataFrame(rows, "`conv_id` string, turn int, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.chat_digests(chat.format_chat(table)).collect()}
    assert got == {"k.2": (2, 1), "k": (1, 0)}
    records = spark.createDataFrame([("x-1", '{"instruction": "do", "output": "done"}')], "`an.id` string, json string")
    assert [(r.conv_id, r.role) for r in chat.turns_of_records(records, "json", "an.id").orderBy(F.col("turn")).collect()] == [("x-1", "user"), ("x-1", "assistant")]
