from collections import Counter

import numpy as np
from quarry.llm import language_id


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = language_id.query(spark, sf_dir).join(docs, "doc_id").filter("held_out").collect()
    assert len(found) > 40 and np.mean([r.lang == r.lang_pred for r in found]) > 0.95


def test_defined_results(spark, write_docs):
    rows = [(k, t, lang) for k in range(40) for t, lang in [(f"the cat and the hat {k}", "en")]] + [(k, f"der hund und die katze über {k}", "de") for k in range(40, 80)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "123 !?  ", "de"), (93, "a", None), (94, "the hat and the " * 9000, None), (95, "日本", None), (None, "und die katze", None), (40, "der hund und die katze über 40", "de")]
    path = write_docs(rows)
    found = {}
    for r in language_id.query(spark, path).collect():
        found.setdefault(r.doc_id, r)
    assert len(found) == 87
    assert [found[k].lang_pred for k in (90, 91, 92)] == ["und"] * 3 and found[94].lang_pred == "en" and found[None].lang_pred == "de"
    assert found[93].lang_pred in ("en", "de") and all(0 <= r.score <= 1 for r in found.values())


def plain_predictions(train, texts):
    """The same model by dictionaries: n-gram counts of each language, a log odds ratio for each bit, the least loss."""
    languages = sorted({lang for _, lang in train})
    code, n_pairs = language_id.codewords(len(languages)), 1 << 16

    def grams(text):
        b = b" " + text.lower().encode() + b" "
        yield from (("two", b[k] << 8 | b[k + 1]) for k in range(len(b) - 1))
        yield from (("three", ((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761 % 2**32) >> 16) for k in range(len(b) - 2))

    count = {x: Counter(g for t, lang in train if lang == x for g in grams(t)) for x in languages}
    total = {(x, o): sum(n for g, n in count[x].items() if g[0] == o) for x in languages for o in ("two", "three")}
    chance = lambda x, g: (count[x][g] + 0.5) / (total[x, g[0]] + 0.5 * n_pairs)
    side = lambda j, s, g: np.mean([chance(x, g) for x, c in zip(languages, code, strict=True) if c[j] * s > 0])
    odds = lambda j, g: np.log(side(j, 1, g)) - np.log(side(j, -1, g))
    seen = {g for x in languages for g in count[x]}
    rest = {o: next((o, k) for k in range(n_pairs) if (o, k) not in seen) for o in ("two", "three")}
    apart = []
    for j in range(code.shape[1]):
        gain = sum((side(j, 1, g) - side(j, -1, g)) * odds(j, g) for g in seen)
        for o, g in rest.items():
            gain += (n_pairs - sum(s[0] == o for s in seen)) * (side(j, 1, g) - side(j, -1, g)) * odds(j, g)
        apart.append(gain)
    weight = np.array(apart) / np.mean(apart)
    out = []
    for t in texts:
        size = len(t.lower().encode()) + 2
        margin = np.array([sum(odds(j, g) for g in grams(t)) for j in range(code.shape[1])]) / size * min(size, 64) / 8
        loss = (np.log1p(np.exp(-margin * code)) * weight).sum(axis=1)
        share = np.exp(-loss) / np.exp(-loss).sum()
        out.append((languages[int(loss.argmin())], float(share.max())))
    return out


def test_equals_a_plain_model(spark, docs_of):
    train = [("the cat and the hat", "en"), ("a dog in the fog", "en"), ("der hund und die katze", "de"), ("ein haus über dem fluss", "de"), ("le chat et le chien", "fr")]
    texts = ["the dog", "die Katze", "le fleuve et la maison", "x", "THE hat " * 30, "日本"]
    model = language_id.fit(docs_of([(k, t, lang) for k, (t, lang) in enumerate(train)]))
    found = {r.doc_id: r for r in language_id.predict(docs_of([(k, t) for k, t in enumerate(texts)]), model).collect()}
    for k, (lang, score) in enumerate(plain_predictions(train, texts)):
        assert found[k].lang_pred == lang and abs(found[k].score - score) < 1e-4


def test_signs_are_no_letters(spark, docs_of):
    docs = docs_of([(1, "the cat", "en"), (2, "die katze", "de")])
    found = language_id.predict(docs_of([(1, "½ ²"), (2, "Ⅷ _ 7"), (3, "ª")]), language_id.fit(docs)).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in found} == {1: True, 2: True, 3: False}


def test_no_training_rows_and_one_language(spark, docs_of):
    docs = docs_of([(1, "some text", None)])
    assert [r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()] == ["und"]
    docs = docs_of([(1, "some text", "en"), (2, "7", "en")])
    assert sorted(r.lang_pred for r in language_id.predict(docs, language_id.fit(docs)).collect()) == ["en", "und"]
    assert language_id.predict(docs.limit(0), language_id.fit(docs)).collect() == []


def test_codewords_stand_apart():
    for n in (2, 4, 7, 12, 40):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n
        if n > 2:
            assert min((a != b).sum() for k, a in enumerate(code) for b in code[:k]) >= 2


def test_decoding_flags_ambiguity():
    model = language_id.LanguageModel(["a", "b", "c"], language_id.codewords(3), None, np.ones(3))
    best, sure = language_id.decode(model, np.array([[5.0, 5.0, 5.0], [0.0, 0.0, 0.0]]) * model.codewords[1])
    assert best[0] == 1 and sure[0] > 0.9 and sure[1] < language_id.AMBIGUOUS_BELOW
