"""License detections against the same rules tried at every place in Python."""

import re

from roleweave.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, table):
    words = WORD.findall((text or "").translate(LOWER))
    norm = " " + " ".join(words) + " "
    found = []
    for n, rule in enumerate(table):
        for m in re.finditer(rf"(?<= )(?:{rule.pattern})(?= )", norm) if rule.keyword in norm else ():
            start = norm[: m.start()].count(" ") - 1
            found.append((n, rule, start, start + len(m[0].split(" "))))
    kept = []
    for n, rule, start, stop in found:
        stronger = any(
            s <= start and e >= stop and (o.priority, e - s, -k) > (rule.priority, stop - start, -n) for k, o, s, e in found
        )
        if rule.base or not stronger:
            kept.append((rule, start))
    places = [s for r, s in kept if r.base]
    labels = lambda only: ",".join(sorted({r.label for r, _ in kept if r.base or not only}))
    score = max((r.priority / 100 for r, _ in kept), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), labels(True), labels(False), score


def test_there_are_hundreds_of_rules_with_their_keywords():
    table = licenses.rules()
    assert len(table) > 300
    assert all(re.compile(r.pattern) for r in table)


def test_matches_brute_force(documents, prose):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "Released under the MIT License."), (3, "cc by cc by CC-BY 4.0 cc by-nc-sa 3.0"),
        (4, "GNU General Public License version 3 or any later version; GNU General Public License, all rights reserved"), (5, None), (6, ""),
        (7, prose(1, 4000) + " This work is licensed under the GNU Lesser General Public License v2.1 " + prose(2, 500) + " All Rights Reserved."),
        (8, "no licence here"), (None, "All rights reserved"), (9, "all rights reserved"), (9, "mit license"), (9, "mit license"),
        (10, "xcc by y"), (11, "cc byé cc\nby"), (12, "Copyright (c) 2020 by someone, subject to the terms of the Mozilla Public License 2.0; see the license file for details"),
        (13, "cc by " * 300),
    ]
    table = licenses.rules()
    got = licenses.license_notices(documents(rows, extra=True)).collect()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    mine = sorted((str(r["doc_id"]), str([r[n] for n in names])) for r in got)
    assert mine == sorted((str(i), str(list(brute(t, table)))) for i, t in rows)


def test_empty_table(documents):
    assert licenses.license_notices(documents([])).collect() == []
