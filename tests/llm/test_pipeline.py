import corpus_pipeline
from chronoloom.llm import common, queries


def test_stages_keep_the_columns(spark, small):
    docs = common.read_table(spark, small, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        docs = out.checkpoint()
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0


def test_run_equals_its_stages(spark, small):
    docs = common.read_table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).checkpoint()
    assert sorted(map(str, corpus_pipeline.run(spark, small).collect())) == sorted(map(str, docs.collect()))


def test_stages_take_hard_rows(hard, none, spark, small):
    for docs in (hard, none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, small).count()


def test_registered_queries_have_the_contract_columns(spark, small):
    columns = {
        "op1": {"doc_id", "size", "source_size", "target", "taken"},
        "op4": {"doc_id", "held_out", "lang_pred", "score"},
        "op6": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
        "op10": {"page_id", "host", "path", "rule", "verdict"},
    }
    for name, f in queries.QUERIES.items():
        want = columns.get(name.split("_")[0])
        assert want is None or want <= set(f(spark, small).columns)
