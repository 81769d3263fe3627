import re

import corpus_pipeline
from helpers import SCHEMA, odd_rows
from test_near_dedup import brute
from test_secrets import base

from revq.llm import language, mixing, secrets, sentencepiece
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_run_equals_stages_by_hand(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    all_rows = docs.collect()
    told = {r.doc_id: r.score for r in language.identify(docs, F.lit(True)).collect()}
    size = {r.doc_id: int(language.length_class(language.trigrams(r.text)[1].sum())) for r in all_rows}
    classes = {c: sorted(told[i] for i in told if size[i] == c and told[i] > 0) for c in set(size.values())}
    # the sketch holds so few rows whole: the smallest value whose rank reaches the quantile
    least = {c: 0.4 * v[-(-len(v) // 20) - 1] if len(v) >= 50 else 0.02 for c, v in classes.items()}
    one = [r for r in all_rows if told[r.doc_id] >= max(0.02, least[size[r.doc_id]])]
    groups = brute([(r.doc_id, r.text) for r in one])
    two = [r for r in one if groups[r.doc_id][1] == r.doc_id]
    weak = {r.doc_id for r in secrets.spans(docs).collect()}
    three = [r for r in two if r.doc_id not in weak]
    assert not any(base(r.text) for r in three)
    four = mixing.mix(spark.createDataFrame(three, docs.schema)).collect()
    times = {r.doc_id: r.taken // r.size for r in four if r.taken}
    got = {}
    for r in rows:
        if r.chunk == 0:
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == times
    model = sentencepiece.model(sentencepiece.model_path())
    texts = {r.doc_id: r.text for r in three}
    for r in rows:
        if r.n_chunks == 1:
            assert model.decode(r.ids)[1:] == texts[r.doc_id] and r.n_pieces == len(r.ids)
    assert len(three) <= len(two) < len(one) <= len(all_rows)


def test_stages_keep_columns_and_odd_rows(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name
        assert stage(spark, empty, SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).filter("chunk = 0").count() == odd.count()


def test_clean_rows_stay(spark):
    clean = [r for r in odd_rows() if r[0] in (1, 7, 13, 14)]
    df = spark.createDataFrame(clean, SCHEMA).dropDuplicates()
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, SF).count() == df.count() == 4
    assert re.match("language_id", corpus_pipeline.STAGES[0][0])
