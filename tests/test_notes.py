"""Questions about customers against every note of the user."""

import datetime as dt

from taxloom.operators import notes


def fits(pattern, name):
    """ILIKE of one pattern, by hand."""
    def at(p, n):
        if not p:
            return not n
        if p[0] == "%":
            return any(at(p[1:], n[i:]) for i in range(len(n) + 1))
        if p[0] == "\\":
            return bool(n) and n[0] == p[1] and at(p[2:], n[1:])
        return bool(n) and p[0] in ("_", n[0]) and at(p[1:], n[1:])

    return at("%" + pattern.lower() + "%", name.lower())


def test_names_equal_ilike_of_all_pairs(spark):
    names = [("u", n) for n in ("Acme Ltd", "ACME", "Zed", "a", "", "Ac_me", "50% Off", "Élan Vital", "aaa aaa")] + [("v", "Acme"), (None, "Acme")]
    asked = [(u, w) for u in ("u", "v", "w") for w in ("acme", "me l", "a%td", "", "%", "_", "A", "ZE", "élan", "c\\_m", "0\\%", "aaaa", "nobody", "a_a")]
    got = notes.names_asked_for(spark.createDataFrame(asked, "user_id string, wanted string"),
                                spark.createDataFrame(names, "user_id string, noted string"))
    want = sorted((u, w, n) for u, w in asked for o, n in names if o == u and fits(w, n))
    assert sorted(map(tuple, got.collect())) == want


def test_answers(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    held = spark.createDataFrame([("u", "Acme Ltd", "ready", "one", at(1)), ("u", "Acme Gulf", "ready", "two", at(2)), ("u", "Zed", None, "three", at(3)),
                                  ("u", None, "ready", "four", at(4)), ("v", "Acme", "ready", "five", at(5))],
                                 "user_id string, customer_name string, status string, notes string, created_at timestamp")
    asked = spark.createDataFrame([(1, "u", "acme"), (2, "u", "Zed"), (3, "u", None), (4, "w", "acme"), (5, "u", "nobody"), (6, "u", "ACME"), (7, "w", None)],
                                  "request_id int, user_id string, customer_name string")
    got = {r.request_id: r.answer for r in notes.note_answers(asked, held, 2).collect()}
    assert got[1] == got[6] and [line.split(" | ")[2] for line in got[1].split("\n")] == ["two", "one"]
    assert got[2].startswith("* Zed | - | three") and " | four | " in got[3]
    assert (got[4], got[5], got[7]) == ("No filing records for acme.", "No filing records for nobody.", "No filing records.")
    assert notes.note_answers(asked, held.limit(0), 2).filter("answer not like 'No filing records%'").count() == 0
