"""Personal data and secrets that no base pattern matches, planted in prose: what the methods add, and what they leave alone."""

import random
import string

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ALNUM = string.ascii_letters + string.digits
PROSE = ["the committee met again on Tuesday and agreed on the plan.", "Wir fahren morgen mit dem Zug nach Hause.", "la casa esta cerca del mar y tiene jardin.", "total = compute_sum(values, start=0)"]


def planted(rng, what):
    """(text, where the planted piece starts and ends)."""
    before = " ".join(rng.choices(PROSE, k=3)) + "\n"
    return before + what + "\n" + " ".join(rng.choices(PROSE, k=3)), len(before), len(before) + len(what)


def test_planted_secrets():
    """100 of each kind. Secrets are all found; names, paths and data without a sensitive word before them stay quiet; a
    compound of long words that the dictionary lacks is reported at times."""
    from evalsift.llm import secrets as S

    rng = random.Random(3)
    r = lambda n, a=ALNUM: "".join(rng.choice(a) for _ in range(n))
    bad = {
        "bearer": lambda: f"Authorization: Bearer {r(32)}", "cookie": lambda: f"session cookie {r(20)}.{r(40)}.{r(30)}", "private key": lambda: "-----BEGIN PRIVATE KEY-----\n" + "\n".join(r(64, ALNUM + "+/") for _ in range(3)),
        "connection": lambda: f"auth postgres://app:{r(20)}@db.example.com/main", "signature": lambda: f"X-Signature={r(44, ALNUM + '+/')}", "key": lambda: f"the key is {r(24)} now",
    }
    good = {
        "identifier": lambda: "private_key_settings_environment_configuration", "path": lambda: "secret path /usr/local/share/configuration/environment/settings", "camel": lambda: "token authenticationRequestHandlerConfiguration",
        "data": lambda: f"image data {r(60, ALNUM + '+/')}", "repeat": lambda: "key " + "abc" * 8, "compound": lambda: "the authorization of the internationalization-committee",
    }

    def found(make):
        hits = 0
        for _ in range(100):
            text, lo, hi = planted(rng, make())
            hits += any(lo <= s < hi for s, _, _ in S.scan(text, {})[1])
        return hits

    assert all(found(make) == 100 for make in bad.values())
    alarms = {k: found(make) for k, make in good.items()}
    assert alarms.pop("compound") <= 30 and not any(alarms.values()), alarms


def test_planted_personal_data(spark):
    """40 of each kind among the documents: recall of the added spans, and alarms on pieces of a like form."""
    from evalsift.llm.pii import KINDS, find_pii

    rng = random.Random(5)
    d = lambda n: "".join(rng.choice(string.digits) for _ in range(n))

    def card():
        body = "4" + d(14)
        total = sum(x if i % 2 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(map(int, reversed(body))))
        n = body + str(-total % 10)
        return "credit card " + "/".join(n[i : i + 4] for i in range(0, 16, 4))

    name = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(7))
    true = {"email": lambda: f"please write to {name()} [at] {name()}.example.com", "ip": lambda: "server address 2001:db8:85a3:0:0:8a2e:" + d(3) + ":7334", "card": card, "phone": lambda: f"call 555-{rng.randint(200, 999)}-{d(4)}"}
    false = {"email": lambda: f"thanks @{name()} again", "card": lambda: f"row 1{d(3)}/{d(4)}/{d(4)}/{d(4)} of", "ip": lambda: f"at {rng.randint(300, 999)} . 400 . 500 . 600 they"}
    rows, expect = [], {}
    for good, kinds in ((True, true), (False, false)):
        for kind, make in kinds.items():
            for _ in range(40):
                text, lo, hi = planted(rng, make())
                expect[10**6 + len(rows)] = (good, kind, lo, hi)
                rows.append((10**6 + len(rows), text))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    hits = dict.fromkeys([(g, k) for g, k, _, _ in expect.values()], 0)
    for r in find_pii(docs).where(F.col("doc_id") >= 10**6).select("doc_id", "spans").collect():
        good, kind, lo, hi = expect[r["doc_id"]]
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        hits[good, kind] += any(k == kind and lo <= int(s) < hi for k, s, _ in spans)
    assert {k for g, k in hits if g} == set(KINDS) and all(n >= 38 for (good, _), n in hits.items() if good), hits
    # spaced numbers beyond 255 are not asked about: all 40 of them are reported as addresses, a known weakness (README)
    assert hits[False, "email"] <= 2 and hits[False, "card"] <= 2, hits
