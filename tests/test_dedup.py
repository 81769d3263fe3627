"""De-duplicating append (W2): micro cases and a property test against a
plain-Python first-wins model."""

from hypothesis import given, settings
from hypothesis import strategies as st

from revq.operators.dedup import dedup_append, first_per_key
from revq.operators.ingest import overlap_proof

SCHEMA = "review_id string, arrival_seq long, product_id string"


def test_micro_cases(spark):
    store = spark.createDataFrame([("k_old", 0, "p1")], SCHEMA)
    batch = spark.createDataFrame(
        [
            ("k1", 1, "p1"),  # new
            ("k1", 2, "p1"),  # in-batch duplicate
            ("k_old", 3, "p1"),  # already stored
            (None, 4, "p1"),  # NULL key: skipped
            ("", 5, "p1"),  # '' is a valid key ...
            ("", 6, "p2"),  # ... so the second '' collapses into it
        ],
        SCHEMA,
    )
    acc = sorted((r.review_id, r.arrival_seq) for r in dedup_append(batch, store).collect())
    assert acc == [("", 5), ("k1", 1)]
    o = overlap_proof(batch, store).first()
    assert (o.attempted, o.new_count, o.already_stored, o.in_batch_duplicates, o.null_keys) == (6, 2, 1, 2, 1)


def test_store_self_test_twice(spark):
    """Three rows stored twice: 3 new then 0 new / 3 skipped."""
    rows = [("a", 1, "p1"), ("b", 2, "p1"), ("c", 3, "p2")]
    first = first_per_key(spark.createDataFrame(rows, SCHEMA))
    assert first.count() == 3
    again = dedup_append(spark.createDataFrame([(k, s + 10, p) for k, s, p in rows], SCHEMA), first)
    assert again.count() == 0


@settings(max_examples=15, deadline=None)
@given(
    store_keys=st.lists(st.sampled_from(list("abcdefgh")), max_size=5, unique=True),
    batch_keys=st.lists(st.one_of(st.none(), st.sampled_from(list("abcdefghij"))), max_size=25),
)
def test_property_first_wins(spark, store_keys, batch_keys):
    store = spark.createDataFrame([(k, i, "p") for i, k in enumerate(store_keys)], SCHEMA)
    batch_rows = [(k, 100 + i, "p") for i, k in enumerate(batch_keys)]
    batch = spark.createDataFrame(batch_rows, SCHEMA)
    seen, expect = set(store_keys), []
    for k, seq, _ in batch_rows:
        if k is not None and k not in seen:
            seen.add(k)
            expect.append((k, seq))
    got = sorted((r.review_id, r.arrival_seq) for r in dedup_append(batch, store).collect())
    assert got == sorted(expect)
