import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sparloom.llm import pii as P
from sparloom.llm import queries as Q


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def slow_base(text):
    out = []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text, span):
    a, k, b = span
    value = text[a:b]
    return k, re.sub("[^0-9]", "", value) if k in (2, 3) else value.lower()


def slow_terms(texts, disclosure=0.7, prior=0.25):
    """Term spans of each text."""
    n, rows_e, rows_t, texts_of = len(texts), defaultdict(set), defaultdict(set), defaultdict(set)
    base = [slow_base(t) for t in texts]
    for r, t in enumerate(texts):
        for s in base[r]:
            rows_e[entity(t, s)].add(r)
        for w in re.findall(r"[^\W_]+", t):
            rows_t[w.lower()].add(r)
    out = []
    for r, t in enumerate(texts):
        found = set()
        for m in re.finditer(r"[^\W_]+", t):
            for e in {entity(t, s) for s in base[r]}:
                both = rows_e[e] & rows_t[m[0].lower()]
                content, m_texts = math.log2(n / len(rows_e[e])), len({texts[i] for i in both})
                pmi = math.log2(len(both) * n / (len(rows_t[m[0].lower()]) * len(rows_e[e])))
                if content > 0 and pmi * m_texts / (m_texts + prior) >= disclosure * content - 1e-9:
                    if not any(a <= m.start() and m.end() <= b for a, _, b in base[r]):
                        found.add((m.start(), 4, m.end()))
        out.append(sorted(found))
    return out


def made(seed, n=80):
    rng = random.Random(seed)
    bits = ["anna.k@mail.example.com", "a@b", "x@y.z@q.r_s@t.u", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (716) 555-8176", "+12", "+49.30.1234567 8", "12", "é"]
    fill = ["the", "of", "running", "house", "Tür", "a", "1999", "x9y", "\n", "no-one", "über", "...", "end."]
    out = []
    for _ in range(n):
        parts = [rng.choice(fill) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(bits))
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, len(parts)), f"zorbtown{rng.choice(['', ','])} {rng.choice(fill)} anna.k@mail.example.com {rng.choice(fill)} Quixcorp")
        out.append(rng.choice([" ", " ", ""]).join(parts))
    return out


def slow_sanitized(text, spans):
    out, at, last = [], 0, -1
    for a, k, b in sorted(spans, key=lambda s: (s[0], s[2])):
        name = "NUMBER" if k == 4 and re.search("[0-9]", text[a:b]) else P.KINDS[k].upper()
        if a >= last:
            out += [text[at:a], f"[{name}]"]
        last = at = max(last, b)
    return "".join([*out, text[at:]])


def test_spans_and_terms_match_brute_force(spark):
    texts = made(1) + made(2)
    texts += texts[:5] + ["", "1 " * 5000 + "10.0.0.1 " * 700, "+" * 500 + "(" * 3000, "a" * 20_000, "call +1 (716) 555-8176 quixotic", "card 4111-1111-1111-1111 quixotic"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(999, None, "k")], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in P.pii_spans(docs).collect()}
    assert len(got) == len(texts) + 1 and got[999].base == [] and got[999].sanitized is None
    terms = slow_terms([*texts, ""])
    assert sum(map(bool, terms)) > 20
    for i, t in enumerate(texts):
        r = got[i]
        spans = sorted((x.start, P.KINDS.index(x.kind), x.end) for x in r.base)
        assert spans == slow_base(t), t[:200]
        assert sorted((x.start, 4, x.end) for x in r.terms) == terms[i]
        assert all(t[x.start : x.end].lower() == x.value for x in r.terms)
        assert (r.sanitized or t) == slow_sanitized(t, spans + terms[i])


def test_planted_terms_are_found(spark):
    """The rare words beside a person's data are found wherever they stand, common ones stay; copies are no evidence."""
    rng = random.Random(3)
    usual = [f"word{i}" for i in range(200)]
    rows, planted = [], {}
    for i in range(400):
        words = [rng.choice(usual) for _ in range(60)]
        if i % 8 == 0:
            planted[i] = f"zorbina{i}"
            words = [planted[i], *words, f"p{i}@mail.org", *[rng.choice(usual) for _ in range(30)], planted[i].upper()]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[1][1] + " q@r.st common") for i in range(60)] + [(2000 + i, f"common {rng.choice(usual)} {i}") for i in range(200)]
    got = {r.doc_id: r for r in P.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum({x.value for x in got[i].terms} == {w} and len(got[i].terms) == 2 for i, w in planted.items())
    assert caught == len(planted)
    assert all(w.lower() not in got[i].sanitized.lower() for i, w in planted.items())
    assert not any(r.terms for i, r in got.items() if i not in planted)


def test_query_and_sanitized(spark, tmp_path):
    texts = made(7, 30)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = Q.op5_pii(spark, str(tmp_path)).collect()
    assert len(rows) == 32
    for r in rows:
        base = slow_base(texts[r.doc_id] if r.doc_id is not None else "")
        want = [f"{P.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(want) <= set(r.spans.split(",")) or not want
    one = spark.createDataFrame([("see bob@x.org now 9lives",)], "t string")
    span = F.expr("array(named_struct('kind','email','start',4L,'end',13L,'value','bob@x.org'), named_struct('kind','term','start',18L,'end',24L,'value','9lives'), named_struct('kind','term','start',6L,'end',9L,'value','b@x'))")
    assert one.withColumn("s", P.united(span)).select(P.sanitized("t", "s")).first()[0] == "see [EMAIL] now [NUMBER]"
    assert P.pii_spans(docs.limit(0)).count() == 0
