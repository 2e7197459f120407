import hashlib
import random
import re
import time
from collections import Counter

from loomstone.llm import pii
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c)
        t += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return t % 10 == 0


def base(text):
    text = text or ""
    fig = lambda v: re.sub("[^0-9]", "", v)
    out = {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(fig(m[0])) <= 19 and luhn(fig(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(fig(m[0])) <= 15],
    }
    return out


def show(out):
    return ",".join(f"{k}:{a}:{b}" for k, v in out.items() for a, b in v)


GOOD = "4539578763621486"
ROWS = [
    (1, "mail a.b@c.de, x@y and a@b.co_z@q.org! 😀 é.w@x-y.z.fr."),
    (2, None),
    (3, ""),
    (4, f"card {GOOD} 4539 5787 6362 1486 4539-5787-6362-1487 12 3 {GOOD}99 0"),
    (5, "ip 1.2.3.4.5 256.1.1.1 001.002.003.255 0000000000000000000001.2.3.4 9.9.9"),
    (6, "+1 (017) 555-7713 +49 30 123 +123456789012345678 +5 5 . +44 20 7946 0958. 7"),
    (7, "a" * 60000 + " " + "1 " * 9000 + "x" * 10000 + "@b.c"),
    (None, "x@y.zz"),
]


def test_base_against_brute_force(spark, sf):
    docs = spark.createDataFrame([(d, t, "e") for d, t in ROWS], "doc_id bigint, text string, email string")
    big = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, big):
        out = pii.pii_digest(df)
        assert "Python" not in out._jdf.queryExecution().toString()
        got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out.collect())
        want = []
        for r in df.collect():
            b = base(r["text"])
            want.append((str(r["doc_id"]), *map(len, b.values()), hashlib.sha256(show(b).encode()).hexdigest()))
        assert got == sorted(want)


def brute_discover(texts):
    """New spans by the method, with plain dicts."""
    seeds, follow, everywhere, slots = Counter(), Counter(), Counter(), []
    for d, t in texts:
        words = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        low = [w.lower() for _, w in words]
        at = lambda p: max(i for i, (a, _) in enumerate(words) if a <= p)
        spans = sorted((at(a), a, e) for v in base(t).values() for a, e in v)
        taken = {i for f, a, e in spans for i in range(f, at(e - 1) + 1)}
        for k, (f, a, e) in enumerate(spans):
            if f >= 2 and (k == 0 or spans[k - 1][0] != f):
                seeds[(low[f - 2], low[f - 1]), t[a:e]] += 1
        everywhere.update(w.strip(pii.MARKS) for w in low)
        for i in range(2, len(words)):
            follow[low[i - 2], low[i - 1]] += 1
            core = words[i][1].strip(pii.MARKS)
            if i not in taken and core:
                a = words[i][0] + len(words[i][1]) - len(words[i][1].lstrip(pii.MARKS))
                slots.append((d, a, a + len(core), core.lower(), (low[i - 2], low[i - 1])))
    distinct, filled = Counter(c for c, _ in seeds), Counter()
    for (c, _), n in seeds.items():
        filled[c] += n
    chosen = {c for c, n in distinct.items() if n >= pii.MIN_SEEDS and filled[c] >= pii.MIN_SHARE * follow[c]}
    slots = [s for s in slots if s[4] in chosen]
    behind, edges = Counter(s[3] for s in slots), Counter((s[4], s[3]) for s in slots)
    q, score = Counter(), {}
    for _ in range(pii.ROUNDS):
        score = {c: min(1.0, (filled[c] + sum(n * q[v] for (x, v), n in edges.items() if x == c)) / follow[c]) for c in chosen}
        wrong = {}
        for c, v in edges:
            wrong[v] = wrong.get(v, 1.0) * max(1 - score[c], 1e-9)
        q = Counter({v: min(1.0, behind[v] / everywhere[v]) * (1 - w) for v, w in wrong.items()})
    return {s[:3] for s in slots if score[s[4]] >= pii.MIN_SCORE and q[s[3]] >= pii.MIN_BELIEF}


def card(i):
    number = "4" + f"{i * 7919 + 10**14:014d}"
    return number + str(next(k for k in range(10) if luhn(number + str(k))))


def discovered(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    out = pii.find_pii(docs)
    assert "Python" not in out._jdf.queryExecution().toString()
    return {(r["doc_id"], s["start"], s["end"], s["value"]) for r in out.collect() for s in r["context"]}


def test_seeds_of_each_kind_induce_patterns(spark):
    long = "w" * 90
    texts = []
    for i in range(24):
        texts += [
            (i, f"Please pay from account number {card(i)}, thanks. The year was 2020{i:02d} indeed"),
            (100 + i, f"You may WRITE To <user{i}@mail.org> at night"),
            (200 + i, f"was seen from host 10.0.{i}.7 and left"),
            (300 + i, f"then ring me on +1 (017) 555-77{i:02d} or not; {long} {long}x +49 30 1234{i:02d}9"),
        ]
    texts += [(1000 + i, f"to my Account  Number DE{i:06d}77! and of the 1234{i:03d}5 things") for i in range(4)]
    texts += [(1010, "so write to jane_doe. The end of us"), (1011, "and write to us"), (1012, "from host fe80::17, gone")]
    texts += [(1013, "kindly ring me on ext-417 or come to us"), (1014, f"{long} {long}X (blue-owl-7)"), (1015, None), (1016, "on")]
    texts += [(2000 + i, f"ref code {i:07d} ref code words here us") for i in range(9)]
    got = discovered(spark, texts)
    assert {g[:3] for g in got} == brute_discover([(d, t or "") for d, t in texts])
    assert {g[3] for g in got} == {*(f"DE{i:06d}77" for i in range(4)), "jane_doe", "fe80::17", "ext-417", "blue-owl-7"}


def test_discovery_against_brute_force_on_random_texts(spark):
    rng = random.Random(8)
    for turn in range(2):
        texts = []
        for i in range(120):
            words = []
            for _ in range(rng.randrange(25)):
                words.append(rng.choice(["to", "Mail", "call", "id:", "nr", "(see", "zz7", "ab-9!", f"n{rng.randrange(50)}"]))
                if rng.random() < 0.3:
                    seed = rng.choice([card(rng.randrange(30)), f"u{rng.randrange(30)}@b.org;x@y.z", f"1.2.3.{rng.randrange(40)}", f"+49 30 5555{rng.randrange(9)}"])
                    words += [*rng.choice([("call", "nr"), ("Mail", "to"), ("id:", "zz7")]), seed]
            texts.append((i, rng.choice([" ", "  ", " \n"]).join(words)))
        assert {g[:3] for g in discovered(spark, texts)} == brute_discover(texts), turn


def test_seed_counts(spark):
    docs = spark.createDataFrame([(1, "write me to a@b.c or a@b.c"), (2, "a@b.c"), (3, None)], "doc_id bigint, text string")
    got = {r["kind"]: (r["spans"], r["seeds"]) for r in pii.seed_counts(docs).collect()}
    assert got == {"email": (3, 2), "ip": (0, 0), "card": (0, 0), "phone": (0, 0)}


def test_long_texts_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "12345 " * 40000 + "a@b.c " * 20000)], "doc_id bigint, text string").coalesce(1)
    pii.pii_digest(docs.limit(0)).collect()
    start = time.time()
    assert pii.pii_digest(docs).first()["n_email"] == 20000
    assert time.time() - start < 60


def test_redaction_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    out = pii.find_pii(docs)
    by = {r["doc_id"]: r["t"] for r in out.select("doc_id", pii.redacted(F.col("text"), [(k, F.col(k)) for k in pii.KINDS]).alias("t")).collect()}
    assert by[1] == "mail [EMAIL], x@y and [EMAIL][EMAIL]! 😀 é[EMAIL]." and by[3] == ""
    assert by[4].startswith("card [CARD] [CARD]") or by[4].startswith("card ")
    assert pii.pii_digest(docs.limit(0)).count() == 0


def test_long_redaction(spark):
    rng = random.Random(4)
    words = [rng.choice(["a@b.c", "x", "😀", "1.2.3.4,a@b.c"]) for _ in range(5000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    out = pii.find_pii(docs).select(pii.redacted(F.col("text"), [(k, F.col(k)) for k in pii.KINDS])).first()[0]
    assert out == " ".join(words).replace("a@b.c", "[EMAIL]").replace("1.2.3.4", "[IP]")
