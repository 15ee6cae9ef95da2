"""Boilerplate lines against sets of sites per line."""

from collections import defaultdict

import pytest

from roleweave.llm import line_dedup


def bare(line):
    return " ".join(line.split())


def brute(rows, sites):
    seen = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            seen[bare(line)].add(site)
    bad = {k for k, v in seen.items() if k and len(v) >= sites}
    out = []
    for i, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        kept = None if text is None else "\n".join(x for x in lines if bare(x) not in bad)
        out.append((str(i), sum(bare(x) != "" for x in lines), sum(bare(x) in bad for x in lines), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [line_dedup.Settings(sites=3), line_dedup.Settings(sites=3, precision=4), line_dedup.Settings(sites=2)])
def test_matches_brute_force(documents, prose, settings):
    rows = [(i, f"{prose(i, 8)}\nshared by many\n\n{prose(i % 4, 9)}\n  on  two sites {i % 2}", f"s{i % 7}") for i in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "\n \n", None), (103, "shared by many", None), (None, "shared  by many\nown line", "z")]
    rows += [(104, "x y " * 30_000, "s1"), (105, "twice\ntwice\ntwice", "only"), (105, "twice\ntwice\ntwice", "only")]
    got = line_dedup.remove_boilerplate(documents(rows, extra=True), settings)
    assert "score" in got.columns
    mine = sorted(((str(r["doc_id"]), r["n_lines"], r["n_removed"], r["clean_text"]) for r in got.collect()), key=str)
    assert mine == brute(rows, settings.sites)


def test_far_lines_are_decided_by_sketches(documents):
    rows = [(i, "everywhere\n" + ("near" if i < 11 else "far"), f"site{i}") for i in range(300)]
    lines = line_dedup.spread_lines(documents(rows))
    got = line_dedup.boilerplate(lines, line_dedup.Settings(sites=10)).collect()
    assert sorted((r["exact"], round(r["n_sites"], -1)) for r in got)[0] == (False, 290) or len(got) == 3
    assert sum(r["exact"] for r in got) == 1


def test_empty_table(documents):
    assert line_dedup.remove_boilerplate(documents([])).collect() == []
