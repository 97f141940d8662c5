import random

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import token_counts as C


def library():
    import sentencepiece
    from tokenizers import Tokenizer, models

    p = sentencepiece.SentencePieceProcessor(model_file=C.default_model())
    vocab = [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]
    # Pieces that a text can't match keep their place under names that no text holds.
    return Tokenizer(models.Unigram(vocab, 0, byte_fallback=True))


LIB = library()


def want(text):
    return len(LIB.encode("▁" + text.replace(" ", "▁")).ids) if text else 0


def brute(text, pieces):
    """Every segmentation of a short text: the best score, the earliest start first at each end."""
    table, unk = dict(pieces), min(s for _, s in pieces) - 10
    best = {0: (0.0, 0)}
    for e in range(1, len(text) + 1):
        options = [(best[s][0] + table[text[s:e]], -s, best[s][1] + 1) for s in range(e) if text[s:e] in table]
        if text[e - 1] not in table:
            options.append((best[e - 1][0] + unk, -(e - 1) - 0.5, best[e - 1][1] + len(text[e - 1].encode())))
        s, _, n = max(options)
        best[e] = (s, n)
    return best[len(text)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeé t h\n一\U0001f600", max_size=60))
def test_as_the_library(text):
    assert C.UnigramCounter.from_model(C.default_model())(text)[1] == want(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab▁é", max_size=12))
def test_ties(text):
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aab", -3.0), ("▁", -1.0), ("▁a", -2.0), ("bb", -1.5)]
    assert C.UnigramCounter(pieces).unit(text) == brute(text, pieces)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in C.token_counts(docs).collect()}
    assert got == {i: want(t) for i, t in texts.items()}


def test_odd_rows(spark):
    rng = random.Random(1)
    junk = "".join(rng.choice("abcxyz0189") for _ in range(60000))
    rows = [(1, None, 7), (1, None, 7), (None, "", 7), (3, "  two  spaces ", 7), (4, junk, 7), (5, "a▁b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = C.token_counts(df).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), want((t or "").replace("▁", " "))) for i, t, _ in rows)
    assert C.token_counts(df.limit(0)).count() == 0
