import random

from sparloom.llm import licenses as L


def slow(text, templates):
    """Best containment of each template over all windows that the operator may use, in plain Python."""
    words, out = L.words_of(text or ""), {}
    for name, t in templates.items():
        w = L.words_of(t)
        want, size, k = set(L.shingles_of(w)), L.length_for(len(w)), min(len(w), L.SHINGLE)
        best = max((len(want & set(L.shingles_of(words[i : i + 2 * size], k))) / len(want) for i in range(0, max(1, len(words)), size)), default=0) if words else 0
        if best >= L.CONTAINED:
            out[name] = best
    return out


def test_matches_brute_force(spark):
    rng = random.Random(8)
    fill = ["license", "the", "licensed", "under", "permission", "version", "word", "2", "0", "software", "Zeit", "of", "été"]
    texts = [None, "", "MIT", "Released under the MIT License.", "released UNDER the\nMIT -- license", "Released under MIT License"]
    templates = L.TEMPLATES | {"two words": "word Zeit"}
    for _ in range(150):
        parts = [rng.choice(fill) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = L.words_of(rng.choice(list(L.TEMPLATES.values())))
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(fill)
            at = rng.randint(0, len(parts))
            parts[at:at] = w[: rng.choice([len(w), len(w), len(w) * 9 // 10])]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    texts.append("license " * 40_000 + L.TEMPLATES["ISC"])
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)] + [(3, texts[3], "w"), (None, texts[3], "w")], "doc_id long, text string, w string")
    rows = L.license_matches(docs, templates).collect()
    assert len(rows) == len(texts) + 2
    hits = 0
    for r in rows:
        want = slow(texts[3 if r.doc_id is None else r.doc_id], templates)
        assert {x.name: x.containment for x in r.licenses} == want
        hits += len(want)
    assert hits > 60


def test_bands_keep_their_promise():
    for t in L.TEMPLATES.values():
        w = L.words_of(t)
        s, size = len(L.shingles_of(w)), L.length_for(len(w))
        least = -(-4 * s // 5)
        j = least / (2 * size - 4 + s - least)
        assert (1 - j) ** L.bands_for(s, size) <= L.MISS
        grams = L.shingles_of(w)
        free = [g for g in grams if not L.anchors_of(w) & set(g.split())]
        assert len(free) < L.CONTAINED * len(grams)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License")], "doc_id long, text string")
    assert L.license_matches(docs.limit(0)).count() == 0
    assert L.license_matches(docs, {"none": "!!"}).first().licenses == []
    assert [x.name for x in L.license_matches(docs, {"own": "under the mit"}).first().licenses] == ["own"]


def test_usual_notices_and_the_clauses_of_bsd(spark):
    conditions = L.TEMPLATES["BSD (conditions of 2 and 3 clauses)"]
    third = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    disclaimer = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"
    cc = "This work is licensed under a Creative Commons Attribution-%s 4.0 International License"
    texts = [conditions + disclaimer, conditions + " " + third + disclaimer, cc % "ShareAlike", cc % "NonCommercial-ShareAlike", L.TEMPLATES["AGPL-3 (or later)"], L.TEMPLATES["EPL-2.0"], L.TEMPLATES["CC0-1.0"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {x.name for x in r.licenses} for r in L.license_matches(docs).collect()}
    gnu = [x for x in L.TEMPLATES if "GPL" in x and "or later" in x]
    heads = spark.createDataFrame([(i, f"This is free software: you can redistribute it and/or modify it under {L.TEMPLATES[x]} your option) any later version.") for i, x in enumerate(gnu)], "doc_id long, text string")
    assert {gnu[r.doc_id]: [x.name for x in r.licenses] for r in L.license_matches(heads).collect()} == {x: [x] for x in gnu}
    assert "BSD-3-Clause" not in got[0] and "BSD (conditions of 2 and 3 clauses)" in got[0]
    assert "BSD-3-Clause" in got[1]
    assert "CC-BY-SA-4.0" in got[2] and "CC-BY-NC-SA-4.0" in got[3]
    assert "AGPL-3 (or later)" in got[4] and "EPL-2.0" in got[5] and "CC0-1.0" in got[6]


def test_each_wording_is_told_apart(spark):
    """A document that is one template has that one, and no other but what it holds word for word."""
    names = list(L.TEMPLATES)
    docs = spark.createDataFrame([(i, f"Some words before. {L.TEMPLATES[x]} And after it.") for i, x in enumerate(names)], "doc_id long, text string")
    got = {names[r.doc_id]: {x.name for x in r.licenses} for r in L.license_matches(docs).collect()}
    assert len(names) > 60 and {k: v - {k} for k, v in got.items() if v != {k}} == {"Apache-2.0 (header)": {"Apache-2.0 (notice)"}}
