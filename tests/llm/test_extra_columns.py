"""Every stage returns extra columns unchanged, whatever their names."""

import pytest

import corpus_pipeline

#: Names that the operators use inside, now or before, and names that need quoting.
NAMES = """_rows _sha _cut _host _passes _parts _key _source _node _text_key _right_doc_id _right_text_key _right_node row rows
 host text_key removed kept node component copies text_sha256 ids variants digests place passes parts ranges source_key
 shard size taken target line lines x n key class_id met""".split() + ["a.b", "odd `name`", "with space"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_extra_columns_come_back(spark, name, stage):
    def prose(seed):
        return " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(70))

    columns = ["doc_id", "text", "lang", "source", "n_chars", *NAMES]
    texts = [prose(i) for i in range(12)] + [prose(3), prose(4) + " end", prose(5)]
    rows = [(i, t, "en", "ab"[i % 2], len(t), *[f"{i}:{n}" for n in NAMES]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long"] + [f"`{n.replace('`', '``')}` string" for n in NAMES]))
    found = stage(spark, docs, "")
    assert found.columns == columns and found.schema == docs.schema
    kept = found.collect()
    assert len({r[0] for r in kept}) >= 10
    for r in kept:
        assert list(r[5:]) == [f"{r[0]}:{n}" for n in NAMES] and r[4] == len(r[1])
