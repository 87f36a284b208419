"""Base spans against a second reading of the contract, and the method's additions."""

import random
import re

from forgeclock.llm import pii


def plain(text):
    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(1)
    parts = ["a.b+c@mail.example.com", "x@y", "é", "10.0.0.255", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "+49.30.1234567", "0.0.0.00", " ", "\n", ".", "-", "5"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert [(k, a, b) for a, b, k in pii.base_spans(text)] == plain(text), text


def test_operator(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        number = "".join(rng.choice("0123456789") for _ in range(7))
        extra = [f"user{i}@mail{i % 9}.example.com", f"call +1 (555) {number[:3]}-{number[3:]}", f"host 10.{i % 250}.3.{i % 200}", f"version {i % 9}.0.{i % 5}", f"id {number}{number}"][i % 5]
        rows.append((i, f"Grüße und some words here {extra} then more words follow"))
    rows += [(900, None), (901, ""), (902, "12 " * 20_000), (None, "a@b.cc"), (903, "a@b.cc"), (903, "a@b.cc")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, spans string")
    model = pii.train(docs)
    out = pii.found(docs, model).collect()
    assert len(out) == len(rows)
    for r in out:
        base = plain(r.row.text or "")
        assert r.base == [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(r.base) <= set(r.spans)
        added = [s for s in r.spans if s not in r.base]
        spans = [tuple(map(int, s.split(":")[1:])) for s in added]
        assert all(a[1] <= b[0] or b[1] <= a[0] for a in spans for b in [*spans, *((x, y) for _, x, y in base)] if a != b)
    versions = [r for r in out if "version" in (r.row.text or "")]
    assert versions and not any(r.spans for r in versions)
    assert pii.found(docs.limit(0), model).count() == 0
    assert pii.train(docs.limit(0)).threshold > 1


def test_redacted():
    assert pii.redacted("to a@b.cc or +1 555 555 5555!", ["email:3:9", "phone:13:28"]) == "to <email> or <phone>!"


def test_base_spans_are_widened(spark):
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    rows = [(i, f"please write to {name()}@{name()}.de or version {i % 9}.0.{i % 5} with other words") for i in range(300)]
    rows.append((900, "please write to jürgen@webmail.de or come here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.row.doc_id: r for r in pii.found(docs, pii.train(docs)).collect()}
    assert by[900].base == ["email:18:33"] and "email:16:33" in by[900].spans
    assert pii.redacted(by[900].row.text, by[900].spans) == "please write to <email> or come here"
    assert all(by[i].spans == by[i].base for i in range(300))


def test_other_notations_are_found(spark):
    """Trained on base spans only, the model finds the same data in other notations, and no other numbers."""
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        head = "4" + number(14)
        return next(head + d for d in "0123456789" if pii.luhn(head + d))

    def made(i):
        return [
            f"{name()}.{name()}@{name()}.example.com", f"+1 ({number(3)}) {number(3)}-{number(4)}", card(),
            f"10.{i % 250}.{i % 7}.{i % 200}", f"version {i % 9}.{i % 4}", f"no. {number(16)}",
        ][i % 6]

    docs = spark.createDataFrame([(i, f"some words {made(i)} and others follow") for i in range(1200)], "doc_id long, text string")
    model = pii.train(docs)
    assert set(model.recall) == set(pii.KINDS) and min(model.recall.values()) >= 0.9, model.recall
    planted, wanted = [], {}
    for i in range(400):
        kind = pii.KINDS[i % 4]
        plain_form = {"email": f"{name()}@{name()}.example.org", "phone": f"+1 ({number(3)}) {number(3)}-{number(4)}", "card": card(), "ip": f"10.{i % 250}.3.{i % 99}"}[kind]
        forms = pii.notations(plain_form, kind)
        form = forms[i // 4 % len(forms)]
        planted.append((i, f"then words {form} come again"))
        wanted[i] = f"{kind}:11:{11 + len(form)}"
    planted += [(500 + i, f"then words {number(2)}.{number(1)} and {t} come again") for i, t in enumerate(["tables", "Version 4.0", "2.0", "1999"])]
    out = {r.row.doc_id: r.spans for r in pii.found(spark.createDataFrame(planted, docs.schema), model).collect()}
    hits = {k: [w in out[i] for i, w in wanted.items() if w.startswith(k)] for k in pii.KINDS}
    assert all(sum(h) >= 0.9 * len(h) for h in hits.values()), {k: sum(h) / len(h) for k, h in hits.items()}
    assert not any(out[i] for i in range(500, 504))
