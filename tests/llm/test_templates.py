"""Template decontamination: changed numbers, names and units are caught, inconsistent slots and clean texts are not."""

import random

from forgeclock.llm import templates

ITEM = (
    "Alice buys 12 red apples and 7 green pears at the market near Paris on a sunny morning. "
    "She gives 12 apples away and walks 3 km home. How many pears and apples does Alice have left?"
)
FILL = "then the long story goes on with many other words that no benchmark has ever seen before "


def changed(pairs):
    out = ITEM
    for a, b in pairs:
        out = out.replace(a, b)
    return out


def test_leaks(spark):
    rows = [
        (1, FILL * 3 + ITEM + " " + FILL),
        (2, FILL + changed([("Alice", "Marta"), ("12", "45"), ("7", "19"), ("Paris", "Lyon"), ("3 km", "5 miles")]) + " " + FILL),
        (3, FILL + changed([("Alice buys", "Marta buys"), ("12 red", "45 red"), ("12 apples away", "46 apples away"), ("Alice have", "Paris have")])),
        (4, FILL * 20),
        (5, None),
        (6, ""),
        (7, "12 7 3 45 12 7 3 45 12 7 3 45"),
        (8, "short items are matched as one window what is 5 plus 6 yes"),
        (9, "12 + 30 = 42"),
        (None, ITEM),
        (1, FILL * 3 + ITEM + " " + FILL),
        (10, ITEM[:40] + FILL),
        (11, "12 + 31 = 43 and more"),
    ]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, h string")
    items = [(1, ITEM), (2, "one window what is 3 plus 4"), (3, "12 + 30 = 42"), (4, None), (5, ""), (6, ITEM)]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, pos int")
    found = templates.leaks(docs, benchmark).collect()
    got = sorted({(str(r.doc_id), r.item_id) for r in found})
    assert got == sorted([("1", 1), ("1", 6), ("2", 1), ("2", 6), ("3", 1), ("3", 6), ("8", 2), ("9", 3), ("None", 1), ("None", 6)])
    by = {(r.doc_id, r.item_id): r for r in found}
    assert by[1, 1].coverage == 1.0 and by[1, 1].changed_slots == 0
    assert by[2, 1].coverage == 1.0 and by[2, 1].changed_slots >= 5
    kept = templates.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["4", "5", "6", "7", "10", "11"])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert templates.leaks(docs.limit(0), benchmark).count() == 0
    assert templates.leaks(docs, benchmark.limit(0)).count() == 0
    assert templates.without_leaks(docs, benchmark.limit(0)).count() == 1


def test_template():
    assert [templates.template(w)[0] for w in ("12", "$3.50,", "seven", "km.", "5kg", "Paris", "NASA", "apple,", "--")] == [
        "<number>", "<number>", "<number>", "<unit>", "<number><unit>", "<name>", "nasa", "apple", "--",
    ]


def test_one_changed_name_and_repeated_numbers(spark):
    item = "The farmer Ben sold 3 apples and 3 pears to the baker. The baker paid 9 coins and gave the farmer two cakes for his trouble."
    texts = [
        item.replace("The farmer", "A farmer"),
        item.replace("3 apples", "4 apples").replace("3 pears", "7 pears"),
        item.replace("3 apples", "9 apples"),
    ]
    docs = spark.createDataFrame([(i, f"{FILL} {t} {FILL}") for i, t in enumerate(texts)], "doc_id long, text string")
    found = templates.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    got = {r.doc_id: (r.coverage > 0.9, r.changed_slots) for r in found}
    assert got == {0: (True, 0), 1: (True, 2), 2: (True, 1)}


def test_consistent():
    window = lambda at, *pairs: {"at": at, "own": [f"{i} {o}" for i, o, _ in pairs], "theirs": [f"{i} {t}" for i, _, t in pairs]}
    a, b, c = (f"{templates.NAME} {x}" for x in "abc")
    assert templates.consistent([window(0, (0, a, b)), window(9, (0, a, b)), window(20, (0, a, c)), window(30)]) == ([0, 9, 30], 1)
    assert templates.consistent([window(0, (0, a, b)), window(9, (0, a, a))]) == ([9], 0)
    assert templates.consistent([window(0, (0, a, c)), window(9, (0, b, c)), window(20, (0, b, c))]) == ([9, 20], 1)
    assert templates.consistent([window(0, (0, a, b)), window(9, (0, a, c))]) == ([], 0)
    assert templates.consistent([window(0, (0, a, b)), window(9, (0, a, c)), window(20), window(21, (0, a, a))]) == ([20, 21], 0)


def test_other_letter_case(spark):
    rows = [(1, ITEM.lower()), (2, ITEM.upper()), (3, ITEM), (4, ITEM.lower()[:60])]
    docs = spark.createDataFrame([(i, FILL + t) for i, t in rows], "doc_id long, text string")
    found = templates.leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.matched == r.n_windows, r.changed_slots) for r in found} == dict.fromkeys((1, 2, 3), (True, 0))


def plain_leaks(text, item, size, lexical, coverage):
    """(windows that count, windows) of an item in a text by comparing every place with every place."""
    words, own = text.split(), item.split()
    size = min(size, len(own))
    typed, theirs = ([templates.template(w) for w in x] for x in (own, words))
    plain, there = ([value or token for token, value in x] for x in (typed, theirs))
    places = [i for i in range(len(own) - size + 1) if sum(not v for _, v in typed[i : i + size]) >= min(lexical, size)]
    by_type = bool(places)
    places = places or list(range(len(own) - size + 1))
    lines = {}
    for i in places:
        for j in range(len(words) - size + 1):
            a, b = typed[i : i + size], theirs[j : j + size]
            same = [(t, bool(v)) for t, v in a] == [(t, bool(v)) for t, v in b]
            if by_type and same:
                slots = [[f"{k} {t} {v}" for k, (t, v) in enumerate(x) if v] for x in (a, b)]
                lines.setdefault(j - i, []).append({"at": i, "own": slots[0], "theirs": slots[1]})
            if plain[i : i + size] == there[j : j + size]:
                lines.setdefault(j - i, []).append({"at": i, "own": [], "theirs": []})
    met = {at for windows in lines.values() for at in templates.consistent(windows)[0]}
    return (len(met), len(places)) if places and len(met) >= coverage * len(places) else None


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    pool = "the a farmer baker Ben Ann Carl 3 7 12 apples km miles sold gave paid to 40 home two".split()
    items = [" ".join(rng.choices(pool, k=rng.choice([3, 6, 9, 20, 40]))) for _ in range(12)] + ["7 12 3", "Ben 7 Ann 3 Carl 12 Ben Ann 40 7"]
    swap = {"Ben": "Dora", "Ann": "Eve", "3": "5", "12": "99", "km": "miles"}
    texts = []
    for _ in range(60):
        words = rng.choice(items).split()
        words = [swap.get(w, w) if rng.random() < 0.3 else w for w in words]
        words = [w.upper() if rng.random() < 0.03 else w for w in words]
        texts.append(" ".join(rng.choices(pool, k=rng.randrange(9)) + words + rng.choices(pool, k=rng.randrange(9))))
    texts += [" ".join(rng.choices(pool, k=3000)), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.n_windows) for r in templates.leaks(docs, benchmark, size=6, lexical=3).collect()}
    want = {(d, i): x for d, t in enumerate(texts) for i, item in enumerate(items) if (x := plain_leaks(t, item, 6, 3, 0.5))}
    assert got == want and len(want) > 30
