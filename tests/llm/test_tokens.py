"""The whole-token shortcut on texts with odd white space and special strings, against the library."""

import random


from helixframe.llm import tokens

NAME = "byte_bpe_50k.json"
ODD = ["\u00a0", "\u3000", "\u200b", "\u2028", "\x85", "\x1c", "\ufeff", "<|endoftext|>", "<|endoftext|", "<|", " ", "  ", "\n", "\t \n", "", "\r\n"]
WORDS = ["the", "Word's", "it's", "日本語", "straße", "1234", "...", "x", "don't", "\U0001f600", "e\u0301", "é", "ſ", "#$%", "a_b"]


def mixed(seed):
    r = random.Random(seed)
    return "".join(r.choice(ODD) + r.choice(WORDS) if r.random() < 0.8 else r.choice(ODD) for _ in range(r.randint(1, 60)))


def test_runs_make_up_the_text():
    for seed in range(300):
        text = mixed(seed)
        assert "".join(tokens.runs_of(text)) == text


def test_counts_equal_the_library(spark):
    texts = [mixed(seed) for seed in range(400)] + ["\u00a0" * 50, "<|endoftext|>" * 3, "a\u00a0b " * 2000 + "<|endoftext|> end", " \u3000 ", "日本　語　" * 300]
    library = tokens.merger(NAME).library
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_odd_texts_take_the_shortcut(monkeypatch):
    """Of a text with a no-break space in each line, few pre-tokens are merged; none of the text is given up."""
    text = "this is an ordinary line of common words\u00a0and it goes on with more of them \n" * 50
    merged, whole = [], tokens.proven_whole(NAME)
    monkeypatch.setattr(tokens, "_loaded", {})
    m = tokens.merger(NAME)
    monkeypatch.setattr(m, "count", lambda run, count=m.count: (merged.append(run), count(run))[1])
    assert tokens.count_table(NAME, whole).of([text])[0] and len(set(merged)) <= 3
    assert max(map(len, merged), default=0) < 10
