import random
import zlib

import numpy as np
import pytest

from starquilt.llm import langid as g


def words(r, letters, n):
    return " ".join("".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n))


def test_automaton_accepts_just_the_substrings():
    r = random.Random(3)
    s = [r.randint(0, 3) for _ in range(120)]
    t = g.automaton(s, 4)
    subs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, min(len(s), i + 9) + 1)}
    for _ in range(4000):
        q = [r.randint(0, 3) for _ in range(r.randint(1, 8))]
        state = 0
        for c in q:
            state = t[state, c] if state >= 0 else -1
        assert (state >= 0) == (tuple(q) in subs)


def brute_phrases(text, samples, block):
    """Greedy longest phrases by searching the sample itself; letters are what str.isalpha says of these test texts."""

    def plain(t):
        out = ""
        for c in t:
            c = c.lower() if c.isalpha() else "_"
            out += c if c != "_" or not out.endswith("_") else ""
        return out

    ref = "".join(plain(t) + "|" for t in samples).replace("_|", "_").replace("|", "_")
    text, count = plain(text), 0
    for lo in range(0, len(text), block):
        part, i = text[lo : lo + block], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and part[i : i + n + 1] in ref:
                n += 1
            i, count = i + n, count + 1
    return count, len(text)


@pytest.mark.parametrize("block", [50, 2048])
def test_predictions_are_brute_force(monkeypatch, block):
    monkeypatch.setattr(g, "BLOCK", block)
    r = random.Random(5)
    samples = {"x": [words(r, "abcde", 60), words(r, "abcé", 9)], "y": [words(r, "cdefg", 60)], "z": [words(r, "жшщab", 40)]}
    m = g.Model(samples)
    texts = [words(r, "abcdefgh", 200), "a", "Zz9", words(r, "abc", 90).upper(), words(r, "жabщ", 50), "Ж" * 30, words(r, "cdefg", 900), "é, ж!", "字" * 40]
    total, sizes = m.phrases(texts)
    for k, (t, (lang, score), fits) in enumerate(zip(texts, m.predict(texts), [x[2] for x in m.parsed(texts)], strict=True)):
        want = {name: brute_phrases(t, s, block) for name, s in samples.items()}
        assert {name: (total[j, k], sizes[k]) for j, name in enumerate(m.languages)} == want
        first, second = sorted((n, name) for name, (n, _) in want.items())[:2]
        assert lang == first[1] and score == pytest.approx((second[0] - first[0]) / (second[0] + first[0]))
        learnt = "".join(x.lower() + "_" for x in samples[lang]).replace(" ", "_")
        assert fits == (first[0] <= g.FIT * np.log(len(set(learnt)) + 1) / np.log(len(learnt) + 3) * sizes[k] + g.FEW)
    assert [x[2] for x in m.parsed([samples["x"][0], samples["z"][0], "字" * 40, None, "12"])] == [True, True, False, False, False]
    assert m.predict([None, "12 3"]) == [("und", 0.0)] * 2


def rows(n=400):
    r = random.Random(1)
    abc = {"aa": "abcdeiou", "bb": "klmnoeiu", "cc": "éèàçùaei"}
    return [(i, words(r, abc[lang], r.randint(5, 80)), lang, "s") for i in range(n) for lang in [r.choice(list(abc))]]


def test_held_out_accuracy_and_odd_rows(spark):
    data = rows()
    odd = [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "123 !?", "cc", "s"), (1003, data[0][1], None, "s"), (None, data[0][1], "aa", "s"), (1004, "X" * 200_000, None, "s")]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, lang string, lang_pred string")
    got = g.identify(df).collect()
    assert len(got) == len(data) + len(odd)
    true = {i: lang for i, _, lang, _ in data}
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
        assert 0 <= x.score <= 1
        assert (x.lang_pred == "und") == (x.doc_id in (1000, 1001, 1002))
    held = [x for x in got if x.held_out and x.doc_id in true]
    assert np.mean([x.lang_pred == true[x.doc_id] for x in held]) > 0.97
    kept = g.keep_identified(df)
    # beside those without a letter, the text of 200,000 times one letter that no language has goes
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {x[0] for x in data + odd} - {1000, 1001, 1002, 1004}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(x.doc_id, x.lang_pred, x.score) for x in g.identify(df).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert g.identify(df.limit(0)).count() == 0


def test_scripts_of_many_letters_in_one_model():
    """Every letter of the samples counts, in whatever script, and samples do not shrink with the number of languages."""
    r = random.Random(11)
    cjk = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    abc = {"de": "aeinrstäöüß", "fr": "aeinrstçêéè", "ru": "авеиностр", "uk": "авеінострїєґ", "el": "αεηικοστ", "zh": cjk[:2000], "ja": cjk[1000:], "ko": [chr(c) for c in range(0xAC00, 0xAC00 + 800)]}
    abc |= {f"x{k}": r.sample("abcdefghijklmnopqrstuvwxyz", 9) for k in range(12)}
    samples = {name: [words(r, letters, 300) for _ in range(20)] for name, letters in abc.items()}
    m = g.Model(samples)
    for texts in samples.values():
        learnt = g.letters_of("\n".join(texts))
        symbols = m.symbols(learnt)
        assert g.OTHER not in symbols and len(np.unique(symbols)) == len(np.unique(learnt))
    total, _ = m.phrases(["字 ж", "ж"])
    assert total[m.languages.index("x0")].tolist() == [3, 1]  # a phrase for each letter unknown there, and one for the space
    held = [(name, words(r, letters, 40)) for name, letters in abc.items() for _ in range(20)]
    got = m.predict([t for _, t in held])
    for name in abc:
        assert np.mean([x[0] == name for x, (want, _) in zip(got, held, strict=True) if want == name]) >= 0.9, name


def test_clean_rows_stay_when_nothing_was_learnt(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None), (3, "12 !", None), (4, "", None), (None, "é", "aa")], "doc_id long, text string, lang string")
    assert {x.text for x in g.keep_identified(df).collect()} == {"abc", "é"}


def test_learning_is_bounded_and_whole(spark):
    """Texts of at most LONGEST are learnt whole; one id on many rows, and languages of long texts alone, stay bounded."""
    r = random.Random(8)
    data = [(1000, words(r, "abcde", 20), "aa") for _ in range(3000)] + [(i, words(r, "abcde", 3000), "aa") for i in range(50)] + [(i, words(r, "klmno", 2000), "bb") for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    seen = {}

    class Spy(g.Model):
        def __init__(self, samples):
            seen.update(samples)
            super().__init__(samples)

    before, g.Model = g.Model, Spy
    try:
        g.train(df)
        again = dict(seen)
        g.train(df.repartition(7))
    finally:
        g.Model = before
    assert seen == again
    assert len(seen["aa"]) == g.DOCS and set(seen["aa"]) <= {t for i, t, _ in data if i == 1000}
    assert len(seen["bb"]) == g.DOCS and all(len(t) == g.LONGEST and any(t in x for _, x, _ in data) for t in seen["bb"])
    assert len({x.find(t) for t in seen["bb"] for _, x, lang in data if lang == "bb" and t in x}) > 20  # no prefixes
    kept = g.keep_identified(df.union(spark.createDataFrame([(9, "字典" * 50, None), (10, "字", None)], df.schema)))
    assert {x.doc_id for x in kept.filter("text like '%字%'").collect()} == {10}  # a text in no learnt language goes, one too short to tell stays
