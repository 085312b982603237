import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from phenoweave.llm import stream_dedup


def expected(rows, normalise=lambda t: t):
    """(id, keep_id, group_size, sha256) of each row."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[normalise(t or "")].append(i)
    out = Counter()
    for i, t in rows:
        text = normalise(t or "")
        known = [x for x in groups[text] if x is not None]
        out[i, max(known, default=None), len(groups[text]), hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def report(df):
    return Counter((r.id, r.keep_id, r.group_size, r.sha256) for r in df.collect())


def write(make_documents, rows, path, mode="append"):
    make_documents(rows).repartition(3).write.mode(mode).parquet(str(path))


def short_digest(text):
    """Sixteen values: nearly all hits are collisions."""
    return F.unhex(F.concat(F.lit("0"), F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 1)))


@pytest.mark.parametrize("digest", [stream_dedup.sha256, short_digest])
def test_odd_and_given_texts(spark, make_documents, odd_texts, some_texts, tmp_path, digest):
    rows = odd_texts + some_texts + [(9_000 + i, "a hot copy") for i in range(150)] + some_texts[:9]
    write(make_documents, rows, tmp_path / "documents")
    found = stream_dedup.deduplicate(spark, str(tmp_path / "documents"), digest=digest)
    assert report(found) == expected(rows)
    # One row of each text stays, also where the largest identifier occurs twice or is missing.
    stays = Counter(r.sha256 for r in found.filter("kept").collect())
    assert set(stays.values()) == {1} and len(stays) == len({t or "" for _, t in rows})


def test_state_outlives_runs_and_batches(spark, make_documents, some_texts, tmp_path):
    docs, state = str(tmp_path / "documents"), str(tmp_path / "state")
    first, second = some_texts[:120] + [(1, "kept so far")], some_texts[80:] + [(7_000, "kept so far"), (0, "kept so far")]
    write(make_documents, first, docs)
    schema = spark.read.parquet(docs).schema
    stream_dedup.absorb(spark, docs, state, schema, batch_bytes=1)  # a micro-batch per file
    assert report(stream_dedup.decisions(spark, docs, state, schema)) == expected(first)
    write(make_documents, second, docs)
    stream_dedup.absorb(spark, docs, state, schema)
    stream_dedup.absorb(spark, docs, state, schema)  # nothing new
    assert report(stream_dedup.decisions(spark, docs, state, schema)) == expected(first + second)
    held = stream_dedup.held(spark, state)
    assert held.count() == len({t or "" for _, t in first + second})
    assert held.schema["keeper"].dataType.names == ["id", "at"]


def test_normalised_and_empty(spark, make_documents, tmp_path):
    rows = [(1, "A b"), (2, "a  B"), (3, None), (4, " "), (5, "ab")]
    write(make_documents, rows, tmp_path / "documents")
    squeezed = stream_dedup.deduplicate(spark, str(tmp_path / "documents"), normalise=lambda t: F.lower(F.trim(F.regexp_replace(t, " +", " "))))
    assert report(squeezed) == expected(rows, lambda t: " ".join(t.lower().split()))
    write(make_documents, [], tmp_path / "none")
    assert stream_dedup.deduplicate(spark, str(tmp_path / "none")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = stream_dedup.deduplicate(spark, "/root/testdata/sf0.001/documents.parquet")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
