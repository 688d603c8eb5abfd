"""Toxicity without labels, language of texts without letters."""

import public_tokenizers
from pyspark.sql import functions as F

from faultsift.llm import language, toxicity


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None), (None, "")], "doc_id long, text string")
    chain = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    for rows in ([], [(7, 1, 1)], [(1, None, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = toxicity.toxicity(docs, labels, chain).collect()
        assert len(got) == 3
        assert all(r.p_toxic is None and r.p_low_quality is None and not r.is_toxic and not r.is_low_quality for r in got)


def test_only_letters_are_letters(spark):
    assert language.words_of("½ ² Ⅷ 12 _ ①") == []
    assert language.words_of("Ab½cd É²x 3d") == ["ab", "cd", "é", "x", "d"]
    texts = ["the cat and the dog", "der hund und die katze", "½ ²", None, "Ⅷ 5"]
    docs = spark.createDataFrame([(i, t, "de" if "der" in (t or "") else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.languages(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert found[2] == found[3] == found[4] == "und"
