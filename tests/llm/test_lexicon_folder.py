"""Where the transducer lies, by how the shared folder is written."""

import pytest

from tidemark.llm import encoding


@pytest.mark.parametrize("scheme, mapped", [("", True), ("file://", True), ("hdfs://nowhere", False)])
def test_plain_paths_are_mapped_too(spark, tmp_path, monkeypatch, scheme, mapped):
    monkeypatch.setattr(encoding, "shared_path", lambda spark, kind: f"{scheme}{tmp_path}/{kind}")
    df = spark.createDataFrame([(1, "the late quote, the late quote")], "doc_id int, text string")
    lexicon = encoding.build_lexicon(df, "text")
    assert (lexicon.folder == f"{tmp_path}/lexicon") == mapped and (lexicon.spare is None) == mapped
    one = encoding.encode(df, "doc_id", "text", lexicon).first()["ids"]
    assert list(one) == encoding._merger(encoding.BYTE_BPE_50K).encode_ordinary("the late quote, the late quote")
