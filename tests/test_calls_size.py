"""What a round of following references sends on."""

from loomgraph.operators import calls


def test_done_references_are_not_sent_on(spark, monkeypatch):
    """A hundred names end at once, one goes on through eight modules: later rounds have rows of that one alone."""
    symbols = [("m0", f"f{i}", "function", f"m0:f{i}") for i in range(100)] + [("m8", "far", "function", "m8:far")]
    bindings = [(f"m{k}", "far", f"m{k + 1}", ["far"]) for k in range(8)]
    frame = spark.createDataFrame
    scopes = calls.Scopes(
        frame(symbols, "module string, qual string, kind string, id string"),
        frame(bindings, "module string, name string, target string, attrs array<string>"),
        frame([], "module string, name string, target string"),
        frame([], "module string, place int, target string"),
        frame([], "module string, cls string, place int, parts array<string>"),
    )
    names = [f"f{i}" for i in range(100)] + ["far"]
    sites = frame([(i, "m0", None, None, [n]) for i, n in enumerate(names)], "call long, module string, caller string, cls string, parts array<string>")
    sizes, plain = [], calls.cut

    def counted(df):
        out = plain(df)
        if "open" in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(calls, "cut", counted)
    got = {r.call: r.callee for r in calls.callees(sites, scopes).collect()}
    assert got == {i: "m8:far" if n == "far" else f"m0:{n}" for i, n in enumerate(names)}
    # 202 rows at most while names end, then that of the one that goes on
    assert sizes[0] > 100 and all(n <= 2 for n in sizes[3:10]) and len(sizes) >= 9
