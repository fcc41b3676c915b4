import hashlib
import random
import re

from gradloom.llm import privacy

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def fine(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in text.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fine(k, m.group()))
    return ",".join(f"{k}:{b}:{e}" for b, _, e, k in found)


def test_patterns_by_brute_force(spark):
    rng = random.Random(8)
    pieces = ["a.b@c.d", "@", "@@", "x@y", "x@y.z.", "é@b.c", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "0001.1.1.1", "00000.0.0.256", "4863730426282943", "4863-7304 2628-2943", "486373042628294",
              "+1 (656) 555-6510", "+49", "+1 2", "+123456789", "++12345678901234567", " ", "\n", "é", "-", ".", "7", "word", "a@b.c@d.e", "(", "x" * 20]
    texts = [None, "", "4863730426282943" * 2, "1." * 300, "a" * 2000 + "@", "@" * 2000, "9" * 20000 + " a@b.c"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    df = spark.createDataFrame([(i if i % 9 else None, i, t, "clash") for i, t in enumerate(texts)], "doc_id long, i int, text string, spans string").repartition(4)
    found = privacy.digest(privacy.personal_data(df.drop("doc_id").withColumnRenamed("i", "doc_id"))).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest(), (texts[r["doc_id"]], r["spans"], spans)
        assert [r[f"n_{k}"] for k in PATTERNS] == [spans.count(f"{k}:") for k in PATTERNS]
        assert set(spans.split(",")) <= set(r["spans"].split(","))


def test_terms_that_reveal_an_entity(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join(f"common{rng.randrange(40)}" for _ in range(n))
    rows = [(i, f"{filler(5)} Zorgan {filler(1)} zed@corp.example {filler(5)}") for i in range(6)]
    rows += [(100 + i, filler(30)) for i in range(200)] + [(400, "Zorgan alone"), (401, None)]
    rows += [(500 + i, "unique copy@corp.example copied") for i in range(30)]  # copies prove nothing
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, source string, n_chars long")
    found = {r["doc_id"]: r["spans"] for r in privacy.digest(privacy.personal_data(docs)).collect()}
    for i in range(6):
        begin = rows[i][1].index("Zorgan")
        assert f"removed:{begin}:{begin + 6}" in found[i] and "common" not in found[i]
    assert found[400] == found[401] == "" and found[500] == "email:7:24" and all(found[100 + i] == "" for i in range(200))
    clean = {r["doc_id"]: r for r in privacy.sanitise(docs).collect()}
    assert "[removed]" in clean[0]["text"] and "[email]" in clean[0]["text"] and "Zorgan" not in clean[0]["text"]
    assert clean[100]["text"] == dict(rows)[100] and clean[401]["text"] is None and len(clean) == len({r[0] for r in rows})


def test_rare_entities(spark):
    """One occurrence with a part of the address near it, two occurrences in different contexts, and what must not be flagged."""
    rng = random.Random(6)
    filler = lambda n: " ".join(f"common{rng.randrange(40)}" for _ in range(n))
    rows = [(0, f"{filler(4)} Quillon {filler(1)} quillon@mail.example {filler(3)}"),
            (1, f"{filler(4)} Varnax {filler(2)} two@mail.example {filler(3)}"), (2, f"Varnax {filler(3)} two@mail.example {filler(6)}"),
            (3, f"{filler(4)} Lonely {filler(2)} one@mail.example {filler(3)}"),
            (4, f"Twice {filler(3)} both@mail.example {filler(30)} Twice {filler(1)} both@mail.example {filler(2)}"),
            (5, "copied Onlyone x@mail.example"), (6, "copied Onlyone x@mail.example")]
    rows += [(100 + i, filler(60)) for i in range(400)]
    found = {r["doc_id"]: r for r in privacy.digest(privacy.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    text = dict(rows)
    flagged = {i: {text[i][int(s.split(":")[1]):int(s.split(":")[2])] for s in r["spans"].split(",") if s.startswith(("removed", "generalised"))} for i, r in found.items()}
    assert flagged[0] == {"Quillon"} and flagged[1] == flagged[2] == {"Varnax"} and flagged[4] == {"Twice"}
    assert not any(flagged[i] for i in (3, 5, 6)) and not any(r["spans"] for i, r in found.items() if i >= 100)
    assert found[0]["n_revealing"] == 1 and found[4]["n_revealing"] == 2


def test_secrets(spark):
    """Keys that nobody could guess, at any place; long words, numbers and repeated letters of ordinary texts are left alone."""
    rng = random.Random(7)
    syllables = ["heit", "lich", "ver", "ung", "schaft", "tion", "ble", "ing", "eau", "été"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() if rng.random() < 0.95 else str(rng.randrange(10**9)) for _ in range(120)) for _ in range(300)]
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    planted = {i: key() for i in range(0, 40, 2)}
    for i, k in planted.items():
        texts[i] = f"é{texts[i]} token = \"{k.upper() if i % 4 else k}\" {texts[i]}"
    texts += ["a" * 30 + " " + "12" * 10, "versicherungsgesellschaftlichkeiten " * 3, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in privacy.digest(privacy.personal_data(docs)).collect()}
    for i, r in found.items():
        if i in planted:
            begin = texts[i].lower().index(planted[i])
            assert f"secret:{begin}:{begin + 40}" in r["spans"].split(",") and r["n_secret"] == 1
        else:
            assert r["n_secret"] == 0, texts[i]
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(docs).collect()}
    assert clean[0].count("[secret]") == 1 and planted[0] not in clean[0] and clean[1] == texts[1]


def test_empty_table(spark):
    assert privacy.digest(privacy.personal_data(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
