"""Sanitisation against the contract's own patterns and plain counting of surroundings."""

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import privacy as op

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def right(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def base(text):
    return sorted(((m.start(), n, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if right(k, m.group())))


def replaced(text, by):
    text = text.replace("\x01", " ")
    for kind, p in PATTERNS.items():
        text = re.sub(p, lambda m: by(kind, m.group()) if right(kind, m.group()) else m.group(), text)
    return text


def entity(kind, match):
    value = re.sub("[^0-9]", "", match) if kind in ("card", "phone") else match.translate(LOWER)
    return f"\x01{kind} {value}\x01"


def plain(docs):
    texts = [(d, t or "") for d, t in docs]
    n_term, n_entity, both, places = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for r, (_, text) in enumerate(texts):
        for w in re.findall(WORD, text.translate(LOWER)):
            n_term[w].add(r)
        if not base(text):
            continue
        tokens = re.findall(rf"\x01[^\x01]+\x01|{WORD}", replaced(text, entity).translate(LOWER))
        for i, c in enumerate(tokens):
            if c[0] == "\x01":
                near = [x for x in tokens[max(0, i - op.NEAR) : i + op.NEAR + 1] if x[0] != "\x01"]
                n_entity[c].add(r)
                for w in near:
                    both[c, w].add(r)
                    places[c, w].add(tuple(near))
    share = defaultdict(float)
    n = len(texts)
    for (c, w), rows in both.items():
        if len(places[c, w]) >= op.EVIDENCE and len(n_entity[c]) < n:
            share[w] = max(share[w], math.log(n * len(rows) / (len(n_entity[c]) * len(n_term[w]))) / math.log(n / len(n_entity[c])))
    act = {w: 5 if s >= op.REMOVE else 4 for w, s in share.items() if s >= op.GENERALISE}
    out = []
    for d, text in texts:
        own = base(text)
        terms = []
        if own:
            masked = replaced(text, lambda kind, m: " " * len(m))
            terms = [(m.start(), act[w], m.end()) for m in re.finditer(WORD, masked) if (w := m.group().translate(LOWER)) in act]
        out.append((d, name(own), name(sorted(own + terms))))
    return sorted(out, key=str), act


def name(spans):
    return ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("x"), "found": F.lit(1), "term": F.lit(2), "flags": F.lit(3)})
    rows = op.sanitise(frame).collect()
    listed = lambda spans: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)
    return sorted(((r.doc_id, listed(r.base), listed(r.spans)) for r in rows), key=str), {(r.doc_id, r.sanitised) for r in rows}


def corpus(seed=4):
    rnd = random.Random(seed)
    common = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(rnd.choices(common, k=n))
    docs = [(i, some(rnd.randrange(40))) for i in range(200)]
    docs += [(200 + i, f"{some(6)} Hermione Granger, badge 4711x, Jane.Doe@Example.com {some(9)} 日本 hermione {some(14)}") for i in range(6)]
    docs += [(210 + i, f"{some(30)} granger {some(3)}") for i in range(2)]
    docs += [(220 + i, "copied words near a.b@c.example whatever the count") for i in range(5)]
    docs += [(230 + i, f"{some(5)} office 555 call +1 (555) 010-9999{i % 2} or 10.0.0.1 {some(5)} office 4111 1111 1111 1111") for i in range(4)]
    return docs


ODD = [
    (500, None), (501, ""), (502, "a@b.c_d@e.f a@b..c x@y.z."), (503, "1.2.3.4.5 999.1.1.1 001.002.003.0255 1.2.3.4@5.6.7.8"), (504, "4111111111111111 4111-1111-1111-1112 1 2 3"),
    (505, "+1 555 0100 000 +12 +1()()2 +123456789012345678"), (506, "naïve 日本𝄞 é x@y.example 𝄞 \x01qabc\x01 5.5.5.5"), (507, "+1.2.3.4 5678901234"), (None, "Null Id null@id.example"),
    (508, "a" * 500 + "@"), (509, "1" * 500), (510, "1 " * 500), (511, "+1" + " " * 500), (512, "x@a" + ".b" * 500), (513, "m@n.example 10.1.1.1 " * 300), (513, "m@n.example 10.1.1.1 " * 300),
]


def test_odd_texts_against_the_patterns(spark):
    assert found(spark, ODD)[0] == plain(ODD)[0]


def test_long_texts_take_linear_time(spark):
    n = 200_000
    docs = [(1, "a" * n + "@"), (2, "1" * n), (3, "1 " * n), (4, "+1" + " " * n), (5, "x@a" + ".b" * n), (6, "m@n.example " * 20_000)]
    got = {d: spans for d, spans, _ in found(spark, docs)[0]}
    assert [got[d] for d in (1, 2, 3, 4)] == [""] * 4 and got[5] == f"email:0:{3 + 2 * n}"
    assert got[6] == ",".join(f"email:{12 * i}:{12 * i + 11}" for i in range(20_000))


def test_terms_against_plain_counting(spark):
    docs = corpus()
    want, act = plain(docs)
    got, texts = found(spark, docs)
    assert got == want
    assert {w for w, a in act.items() if a == 5} >= {"hermione", "badge", "4711x", "office"} and "granger" in act and "copied" not in act
    hidden = dict(texts)[200]
    assert "[EMAIL]" in hidden and not re.search("(?i)hermione|doe|4711x", hidden) and "日本" not in hidden
    assert dict(texts)[210] is None and dict(texts)[0] is None


def test_generalised_by_kind(spark):
    """A name that is also met elsewhere is replaced by its kind, one that is not is removed."""
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choices([f"w{j}" for j in range(50)], k=30))) for i in range(300)]
    docs += [(300 + i, f"x{i} y{i} smith 4711 z8 q{i} me@my.example r{i}") for i in range(4)] + [(400 + i, "smith 4711 z8") for i in range(4)]
    got, texts = found(spark, docs)
    assert got == plain(docs)[0]
    assert dict(texts)[301] == "x1 y1 [WORD] [NUMBER] [CODE] q1 [EMAIL] r1"


def test_terms_in_documents_without_an_entity(spark, tmp_path):
    """The query also takes out what gives an entity away where the entity itself is not named."""
    docs = corpus()
    want, act = plain(docs)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in op.op12_pii(spark, str(tmp_path)).collect()}
    bare = {d: [(m.start(), act[w], m.end()) for m in re.finditer(WORD, t) if (w := m.group().translate(LOWER)) in act] for d, t in docs if not base(t)}
    assert got == {d: name(bare[d]) if d in bare else spans for d, _, spans in want}
    assert got[210] and sum(map(bool, bare.values())) >= 2
    texts = {r.doc_id: r.sanitised for r in op.sanitise(spark.createDataFrame(docs, "doc_id long, text string"), everywhere=True).collect()}
    assert "granger" not in texts[210] and all((texts[d] is None) == (not spans) for d, spans in got.items())


def test_empty_table_and_digest(spark, tmp_path):
    assert found(spark, [])[0] == []
    spark.createDataFrame([(1, "call me@my.example or 10.0.0.1"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    one, two = op.op12_pii(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone, one.spans) == (1, 1, 0, 0, "email:5:18,ip:22:30")
    assert one.base_sha256 == hashlib.sha256(b"email:5:18,ip:22:30").hexdigest() and two.base_sha256 == hashlib.sha256(b"").hexdigest()
