import pytest

from strandloom.sources import gff

LINKS = "line_no long, id string, parent string"


def brute(rows):
    up = {}
    for _, own, parent in rows:
        up.setdefault(own, set()).update(p for p in (parent or "").split(",") if p)
    out = {}
    for line, _, parent in rows:
        seen, now, depth = {}, {p for p in (parent or "").split(",") if p}, 0
        while now:
            depth += 1
            seen |= {p: depth for p in now if p not in seen}
            now = {q for p in now for q in up.get(p, ())} - set(seen)
        out |= {(line, a): d for a, d in seen.items()}
    return out


def test_all_pairs_are_stored_once(spark, monkeypatch):
    """Only pairs of exactly k steps are joined, and no round repeats what is known only to see that nothing is new."""
    counts, stored = [], gff.stored

    def counted(df):
        out = stored(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(gff, "stored", counted)
    rows = [(k, f"f{k}", f"f{k - 1}" if k else None) for k in range(13)]
    got = {(r["line_no"], r["ancestor"]): r["depth"] for r in gff.ancestors(spark.createDataFrame(rows, LINKS)).collect()}
    assert got == brute(rows)
    assert counts.count(max(counts)) == 1, counts


def test_shared_identifiers_shortcuts_and_features_without_a_name(spark):
    """Lines of one identifier keep to their own parents; a long way and a short one give the short one."""
    rows = [(k, f"f{k}", f"f{k - 1},f{k // 2}" if k > 1 else None) for k in range(1, 9)]
    rows += [(20, "twice", "f3"), (21, "twice", "f8"), (22, None, "twice"), (23, "leaf", "twice,nowhere"), (24, "twice", None)]
    got = {(r["line_no"], r["ancestor"]): r["depth"] for r in gff.ancestors(spark.createDataFrame(rows, LINKS)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_loops_of_any_length_are_errors(spark, n):
    rows = [(k, f"f{k}", f"f{(k + 1) % n}") for k in range(n)]
    with pytest.raises(ValueError, match="own ancestor"):
        gff.ancestors(spark.createDataFrame(rows, LINKS))
