"""Base counts against plain loops, and bands that reject texts unlike their language."""

import random
import re

import public_tokenizers
import sentencepiece

from forgeclock.llm import fertility


def plain_repeats(words):
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, r in enumerate(runs):
        if runs.count(r) > 1:
            inside.update(range(i, i + 5))
    return len(inside)


def test_repeated_words():
    rng = random.Random(1)
    for _ in range(400):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(0, 30))]
        assert fertility.repeated_words(words) == plain_repeats(words)


def test_base_counts():
    text = "Ab é# $x y\n\n  \nAb é# $x y\n|&<>%*"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, _ = fertility.base_counts(text.encode())
    assert (n, chars, dup) == (len(words), sum(map(len, words)), 1)
    assert symbols == sum(c in "#*$%&|<>" for c in text)
    assert fertility.base_counts(b"") == (0, 0, 0, 0, 0)


def test_token_measures():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = "the cat sat on the mat \U0001f9ff the"
    ids = [i for w in text.split() for i in model.encode(w)]
    per, fallback, spread = fertility.token_measures(text.encode(), "piece_bpe_32k.model")
    assert per == sum(map(len, text.split())) / len(ids)
    assert fallback == sum(model.is_byte(i) for i in ids) / len(ids) > 0
    assert 0 < spread < 4
    assert fertility.token_measures(b" \n", "piece_bpe_32k.model") == (0.0, 0.0, 0.0)


def test_bands(spark):
    rng = random.Random(4)
    words = "the of and to in that it was for on are with his they at be this from have or by one had not but what all".split()
    rows = [(i, " ".join(rng.choices(words, k=60)), ["en", None][i % 2]) for i in range(400)]
    odd = [(1000, " ".join("\U0001f9ff\U0001f9a4"[i % 2] + str(i) for i in range(60)), "en"), (1001, None, "en"), (1002, "", None), (1003, "the " * 60, "en")]
    rare = [(1004, " ".join(rng.choices(words, k=60)), "xx")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd + rare], "doc_id long, text string, lang string, bin int")
    out = {r.doc_id: r for r in fertility.ruled(docs).collect()}
    assert len(out) == len(rows + odd + rare)
    assert sum(not out[i].kept for i in range(400)) <= 2
    assert not out[1000].base_failed and not out[1000].kept
    assert out[1001].base_failed and out[1002].base_failed and out[1003].base_failed and not out[1003].kept
    assert out[1004].kept
    assert fertility.ruled(docs.limit(0)).count() == 0


def test_small_groups_are_judged(spark):
    rng = random.Random(5)
    words = "the of and to in that it was for on are with his they at be this from have or by one had not but what all".split()
    rows = [(i, " ".join(rng.choices(words, k=60)), "en") for i in range(200)]
    odd = lambda n: " ".join("\U0001f9ff\U0001f9a4"[i % 2] + str(i) for i in range(n))
    rows += [(900, odd(60), "xx"), (901, odd(4000), "en"), (902, " ".join(rng.choices(words, k=60)), "xx")]
    out = {r.doc_id: r for r in fertility.ruled(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(out[i].base_failed for i in (900, 901, 902))
    assert [out[i].kept for i in (900, 901, 902)] == [False, False, True]
    assert [fertility.script(t) for t in ("abc", "äbcd где", "где a", "12 \u3042", "")] == ["LATIN", "LATIN", "CYRILLIC", "HIRAGANA", ""]
