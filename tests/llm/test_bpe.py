import pytest
from surfsphere.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [None, "", "  ", "a", "aaaaaaaaaaaaa", "\n\n \n x", "I'll we've don't 12 ３4½ ²", "naïve — «où» ?", "ごめん。本当に", "x" * 5000, "<|endoftext|>", "tab\t\t end\x1c\x1f z \r\n", "𝔘 👩‍👩‍👧", "LET'S 'sx"]


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


def test_ids_equal_those_of_the_public_library_over_several_batches(public):
    b = bpe.ByteBpe()
    for part in (slice(0, 5), slice(5, 9), slice(9, None), slice(0, None)):
        ids, n = b.encode(TEXTS[part])
        ends = n.cumsum()
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == public[part]
        assert b.count(TEXTS[part]).tolist() == [len(x) for x in public[part]]


def test_documents_in_spark(spark, public):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(df).collect()}
    assert got == dict(enumerate(public))
    counted = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df.drop("ids")).collect()}
    assert counted == {i: len(x) for i, x in enumerate(public)}
    assert bpe.encode_documents(df.limit(0)).count() == 0
