"""Kinds of reports by phrases, and the roles of files."""

from fathomline.operators import routing as op

PHRASES = [op.term("R1", "功能单位"), op.term("R1", "esg"), op.Phrase("R1", "Life  Cycle", op.APPLIES), op.term("R2", "scope 1"), op.Phrase("R2", "inventory", op.APPLIES), op.Phrase("R2", "life cycle", op.AGAINST), op.Phrase("R3", "annex", op.DEFINED)]


def test_routes(spark):
    rows = [(1, "a.md", "功能单位 life\n\tCYCLE esg ESG esg"), (2, None, "scope 1 inventory"), (3, None, "scope 1 inventory life cycle"), (4, None, None), (5, "Inventory", "SCOPE　1 annex"), (6, None, "inventory 功能单位 life cycle scope 1")]
    got = {r.doc_id: (r.state, r.selected, [(c.kind, c.score, list(c.matched), list(c.against)) for c in r.candidates]) for r in op.routes(spark.createDataFrame(rows, "doc_id long, filename string, text string"), PHRASES).collect()}
    assert got[1] == ("CONFIDENT", "R1", [("R1", 10.0, ["功能单位", "esg", "Life  Cycle"], []), ("R2", 0.0, [], ["life cycle"]), ("R3", 0.0, [], [])])
    assert got[2][:2] == ("CONFIDENT", "R2") and got[3][2][0][:2] == ("R1", 5.0) and got[3][2][1][1] == 2.0 and got[3][0] == "AMBIGUOUS"
    assert got[4] == ("AMBIGUOUS", None, [("R1", 0.0, [], []), ("R2", 0.0, [], []), ("R3", 0.0, [], [])])
    assert got[5][:2] == ("CONFIDENT", "R2") and got[6][0] == "CONFIDENT" and got[6][1] == "R1"
    assert op.routes(spark.createDataFrame([], "doc_id long, filename string, text string"), PHRASES).count() == 0


def test_roles(spark):
    rows = [(1, None, "inventory"), (2, None, "none"), (3, None, "scope 1"), (4, None, "annex")]
    routed = op.routes(spark.createDataFrame(rows, "doc_id long, filename string, text string"), PHRASES)
    files = [(1, 0, 2), (1, 1, 1), (1, 2, 3), (2, 0, 2), (2, 1, 99), (3, 0, 3), (3, 1, 3), (3, 2, 4), (4, 0, 2), (5, 0, 1)]
    got = {r.request: (r.subject, r.template) for r in op.attachment_roles(spark.createDataFrame(files, "request int, position int, doc_id long"), routed).collect()}
    assert got == {1: (2, 1), 2: (2, 99), 3: (3, 3), 4: (2, None), 5: (None, 1)}
