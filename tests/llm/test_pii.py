import hashlib
import random
import re


from pyspark.sql import functions as F

from logweave.llm.pii import KINDS, SHAPES, find_pii, op1_pii, redact_documents, written

from .util import corpus, documents

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in sorted(out))


ODD = [
    "a@b.c_d@e.f x..y@z-1.co.uk.. @@ q@r q@.r a@b.c@d.e.f %+@-.-", "1.2.3.4.5.6.7.8 0001.0255.0.256 256.1.1.1 1..2.3.4.5 999999999999999999999.1.1.1", "4111 1111-1111 1111, 4111  1111 1111 1111 41111111111111111111111",
    "+1 (736) 555-2678 then +1 23 +4.4.4-4(4)4 4 4 4 4 4) +1 (269) 555-3296 4524132264652876 ++12 345 678 90", "😀é 4111111111111111😀+49 30 1234567890é a.b@c.de", "é" * 50 + "u@v.w", "79927398713 0000 0000 0000 00",
    "a." * 9000 + "@" + "b." * 9000 + "c", "1 " * 9000, "1." * 9001, "+" + "1 " * 9000, "+" * 9000, "x" * 100000,
]


def test_base_equals_plain_patterns(spark, tmp_path):
    rng = random.Random(11)
    texts = corpus() + ODD + ["".join(rng.choice("0123456789 -+@.ab(_") for _ in range(rng.randrange(200))) for _ in range(400)]
    documents(spark, texts, str(tmp_path))
    for r in op1_pii(spark, str(tmp_path)).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (texts[r.doc_id][:200], want, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k) for k in PLAIN]
        assert set(want.split(",")) <= set(r.spans.split(","))


def test_trusted_contexts_discover_unseen_identifiers(spark):
    seeds = [f"please phone +1 (2{i:02}) 555-01{i:02} now" for i in range(10)] + [f"mail x{i}@a.example soon" for i in range(10)]
    texts = seeds + ["please phone (202) 555-0199, or so", "phone 202-555-0147.", "born 202-555-0147 here", "mail me@host please", "code 4111-1111-1111"]
    rows = {r.doc_id: r for r in find_pii(documents(spark, texts), least_support=8, least_reliability=0.7).select("doc_id", written(F.col("spans")).alias("s"), "base").collect()}
    assert rows[21].s == "phone:6:18" and rows[21].base == [] and rows[23].s == "email:5:12"
    assert rows[22].s == "" and rows[24].s == ""
    none = {r.doc_id: r for r in find_pii(documents(spark, texts), least_support=80).select("doc_id", "base", "spans").collect()}
    assert all(r.base == r.spans for r in none.values())


def test_redaction_and_edge_tables(spark):
    docs = documents(spark, ["mail a@b.cd, +1 (269) 555-3296!", None, "é 1.2.3.4é", "none"]).withColumns({"key": F.lit(1), "base": F.lit(2), "row": F.lit(3)})
    out = {r.doc_id: r.text for r in redact_documents(docs).collect()}
    assert out == {0: "mail [EMAIL], [PHONE]!", 1: "", 2: "é [IP]é", 3: "none"} and redact_documents(docs).columns == docs.columns
    assert find_pii(docs.where("false")).collect() == []
    assert find_pii(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 4


def test_all_trusted_contexts_count_however_many_long_or_far(spark):
    words = [f"word{w}" for w in range(205)] + ["long" * 20, "huge" * 1200]
    texts = [f"{w} x{n}_{i}@a.example soon" for n, w in enumerate(words) for i in range(8)]
    first = len(texts)
    texts += [f"so {w}{' ' * (12 if n % 2 else 1)}(me{n}@host), or" for n, w in enumerate(words)] + [f"word1 {'y' * 200}@host"] * 2
    want = [f"email:{t.index('me' + str(n))}:{t.index('),')}" for n, t in enumerate(texts[first:-2])] + ["email:6:211"] * 2
    for most in (100_000, 0):
        rows = find_pii(documents(spark, texts), most_broadcast=most).select("doc_id", written(F.col("spans")).alias("s")).collect()
        assert len(rows) == len(texts) and [r.s for r in sorted(rows, key=lambda r: r.doc_id)[first:]] == want


SHAPE = {k: re.compile(p) for k, p in SHAPES.items()}


def plain_contexts(text, start, end):
    norm = lambda w: re.sub("[0-9]", "0", w.lower())
    left = text[:start].split() if start and text[start - 1].isspace() else []
    behind = re.match(r"\S*\s+(\S+)", text[end:])
    out = [f"<1 {norm(left[-1])}"] if left else []
    out += [f"<2 {norm(left[-2])} {norm(left[-1])}"] if len(left) > 1 else []
    out += [f">1 {norm(behind[1])}"] if behind else []
    return out + ([f"<> {norm(left[-1])} {norm(behind[1])}"] if left and behind else [])


def plain_spans(texts, least_support=5, least_reliability=0.8):
    """What find_pii gives, by dictionaries and loops."""
    graph, tokens = set(), []
    for i, t in enumerate(texts):
        spans = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in base(t).split(",") if x)]
        graph |= {(p, t[a:b].lower(), k) for a, k, b in spans for p in plain_contexts(t, a, b)}
        for m in re.finditer(r"\S*[@0-9]\S*", t):
            if any(a < m.end() and m.start() < b for a, _, b in spans):
                continue
            value = re.sub(r"""^[("'<\[{]+""", "", m[0])
            start = m.start() + len(m[0]) - len(value)
            value = re.sub(r"""[)"'>\]}.,;:!?]+$""", "", value)
            if any(s.match(value) for s in SHAPE.values()):
                own = plain_contexts(t, m.start(), start + len(value))
                tokens.append((i, start, value, own))
                graph |= {(p, value.lower(), None) for p in own}
    members = {p: sum(q == p for q, _, _ in graph) for p in {g[0] for g in graph}}
    seeds = {(p, k): sum(g[0] == p and g[2] == k for g in graph) for p, _, k in graph if k}
    seeds = {x: n for x, n in seeds.items() if n >= least_support}
    unseen = [(p, v) for p, v, k in graph if k is None]
    scores, trusted = {x: n / members[x[0]] for x, n in seeds.items()}, -1
    while trusted != (trusted := sum(r >= least_reliability for r in scores.values())):
        value = {(v, k): sum(scores.get((p, k), 0) for p, w in unseen if w == v) / sum(w == v for _, w in unseen) for v in {v for _, v in unseen} for k in KINDS if SHAPE[k].match(v)}
        scores = {(p, k): (n + sum(value.get((v, k), 0) for q, v in unseen if q == p)) / members[p] for (p, k), n in seeds.items()}
    found = {}
    for i, start, value, own in tokens:
        marks = [(scores[p, k], -n) for p in own for n, k in enumerate(KINDS) if scores.get((p, k), 0) >= least_reliability and SHAPE[k].match(value)]
        if marks:
            found.setdefault(i, []).append((start, -max(marks)[1], start + len(value)))
    return [sorted([(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base(t).split(",") if x)] + found.get(i, [])) for i, t in enumerate(texts)]


def test_spans_equal_plain_loops_and_planted_identifiers_are_found(spark):
    rng = random.Random(5)
    words = [f"v{c}" for c in "abcdefghijklmnop"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    cues = {"email": ("write to", "today"), "ip": ("host", "answers"), "phone": ("ring us", "soon")}
    seed = {"email": lambda i: f"u{i}@a{i % 7}.example", "ip": lambda i: f"10.0.{i}.7", "phone": lambda i: f"+1 202 555 {1000 + i}"}
    hidden = {"email": lambda i: f"boss{i}@intranet", "ip": lambda i: f"10-1-{i}-3", "phone": lambda i: f"202-555-{2000 + i}"}
    texts, planted = [], set()
    for i in range(60):
        kind = rng.choice(list(cues))
        before, behind = cues[kind]
        texts.append(f"{some(3)} {before} {seed[kind](i)} {behind} {some(2)}")
    for i in range(30):
        kind = rng.choice(list(cues))
        before, behind = cues[kind]
        near = rng.choice([(before, some(1)), (some(1), behind), (before, behind)])
        texts.append(f"{some(2)} {near[0]} ({hidden[kind](i)}), {near[1]} {some(1)}")
        planted.add((len(texts) - 1, texts[-1].index("(") + 1))
    texts += [f"{some(3)} {hidden[rng.choice(list(cues))](i + 40)} {some(3)}" for i in range(30)] + ["", "12345678", "a@b 4111111111111111"]
    rows = find_pii(documents(spark, texts)).select("doc_id", "base", "spans").collect()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in rows}
    want = plain_spans(texts)
    assert [got[i] for i in range(len(texts))] == want
    more = {(r.doc_id, s[0]) for r in rows for s in {tuple(x) for x in r.spans} - {tuple(x) for x in r.base}}
    assert len(more & planted) >= 0.9 * len(planted) and len(more - planted) <= 0.1 * len(more)
    print("recall", len(more & planted) / len(planted), "precision", len(more & planted) / len(more))
