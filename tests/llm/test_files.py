"""Flat id files with other tokenizers, end ids and hot ids; the retention of intermediate tables."""
import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from qanat.llm import common, flat_ids

from .test_operators import bag


def test_op4_other_steps_go_through_the_library(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer
    file = json.load(open(P.path("word_bpe_49k.json")))
    assert flat_ids.cuts_as_here(file)
    file["normalizer"]["normalizers"].pop()  # upper case is kept now
    path = str(tmp_path / "other.json")
    json.dump(file, open(path, "w"))
    assert not flat_ids.cuts_as_here(file)
    t = Tokenizer.from_file(path)
    want = Counter()
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[(d, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert bag(flat_ids.write_and_read(docs, tokenizer=path), "doc_id", "n_tokens", "ids_crc32") == want


def test_op4_end_id_must_survive_the_writer(spark, docs, tmp_path):
    with pytest.raises(ValueError, match="end_id 200"):
        flat_ids.write(docs, str(tmp_path / "x"), end_id=200)
    got = flat_ids.write_and_read(docs, end_id=127)
    assert got.count() == docs.count()


def test_op4_a_hot_id_is_many_tasks(spark):
    """Nine tenths of the rows have no id; they lie in several parts, and starts stay gapless."""
    df = spark.range(4000).selectExpr("if(id % 10 = 0, id, null) doc_id", "concat('word ', id) text").repartition(6)
    path = common.scratch(spark, "hot-ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged here
    try:
        flat_ids.write(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = flat_ids.read(spark, path)
    parts = spark.read.format("binaryFile").load(f"{path}/kind=idx").select("part").distinct().count()
    assert parts >= 4
    rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got.collect())
    assert rows[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(rows, rows[1:]))
    known = [d for _, _, d in rows]
    assert known[:3600] == [None] * 3600 and known[3600:] == sorted(known[3600:])


def test_old_intermediate_tables_are_swept(spark, tmp_path):
    import os
    old, new, other = f"llm-x-{'a' * 12}", f"llm-some-thing-{'b' * 12}", "llm-kept"
    for name in (old, new, other):
        os.makedirs(tmp_path / name)
    for name in (old, other):
        os.utime(tmp_path / name, (1, 1))
    assert common.sweep(spark, str(tmp_path)) == [old]
    assert sorted(os.listdir(tmp_path)) == sorted([new, other])
    assert common.sweep(spark, str(tmp_path / "none")) == []
