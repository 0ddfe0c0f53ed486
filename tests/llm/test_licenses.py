"""Templates of whole licenses and notices, with changes in replaceable, optional and mandatory regions."""

import pytest

from kinfold.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this {thing} and associated
documentation files (the "{thing}"), to deal in the {thing} without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the {thing}, and to permit persons to
whom the {thing} is furnished to do so"""
TAIL = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the {thing}."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
THIRD = "3. Neither the name of the Example Foundation nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
CASES = [
    ((MIT + TAIL).format(thing="Software"), ["mit"]),
    ((MIT + TAIL).format(thing="fine font software"), ["mit"]),
    ((MIT + TAIL).format(thing="Software").replace("substantial", "large"), []),
    ((MIT + '.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND').format(thing="Software"), ["mit-0"]),
    (BSD + AS_IS, ["bsd", "bsd-2-clause"]),
    (BSD + THIRD + AS_IS, ["bsd", "bsd-3-clause"]),
    (BSD.replace("1. ", "").replace("2. ", "") + THIRD[3:], ["bsd", "bsd-3-clause"]),
    (GPL.format(""), ["gpl-3"]),
    (GPL.format("Lesser "), ["lgpl-3"]),
    (GPL.format("Affero "), ["agpl-3"]),
    ("Licensed under CC BY-SA 4.0", ["cc-by-sa"]),
    ("Licensed under CC BY 4.0.", ["cc-by"]),
    ("This is not licensed under the MIT License", ["mit"]),
    ("This is not released under the CC BY 4.0", []),
    ("It isn't licensed under the Apache License 2.0", []),
    ("all available paths", []),
    ("", []),
    (None, []),
]


def test_whole_licenses(spark):
    docs = spark.createDataFrame([*((i, x) for i, (x, _) in enumerate(CASES)), (0, CASES[0][0]), (None, "All rights reserved")], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS labels", "2 AS score", "3 AS n_words")
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        if r.doc_id is None:
            assert r.labels == ["all-rights-reserved"]
            continue
        text, want = CASES[r.doc_id]
        if text == "This is not licensed under the MIT License":  # the base phrase stays, the template doesn't count
            assert [p.label for p in r.base_places] == ["mit"]
        else:
            assert list(r.labels) == want, text
        assert r.score == (1 if r.labels else 0) or text == CASES[2][0] and 0.4 < r.score < 0.9


@pytest.mark.parametrize("markup, words, accepted", [("a [[b [[c]] d]] e", "a b d e", True), ("a [[b [[c]] d]] e", "a b e", False), ("a [[b [[c]] d]] e", "a e", True), ("a {{2}} b", "a x y b", True), ("a {{2}} b", "a x y z b", False), ("a b|c !d", "a c d", False), ("a b|c !d", "a c e", True)])
def test_markup(markup, words, accepted):
    assert license_scan.compile_template(markup, "x").run(words.encode().split())[0] is accepted
