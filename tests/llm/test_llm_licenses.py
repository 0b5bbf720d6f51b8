from llm_cases import HARD, make_docs, rows_of  # noqa: F401
from haulage.llm import licenses

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
       "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
       "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
       "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]


def scan(make_docs, *texts):
    return [r[1] for r in rows_of(licenses.scan(make_docs(list(enumerate(texts)))), "doc_id", "licenses")]


def test_rules_over_sentences(make_docs):
    assert scan(make_docs, MIT, "\n".join(BSD), "\n".join(BSD[:3]), "\n".join(BSD[:1]), "\n".join(reversed(BSD)),
                "Prose before.\nLicensed under the Apache License, Version 2.0.\nProse after it", "prose about a license, an mit one",
                f"Released under the MIT License. Then: {BSD[0]} {BSD[1]} and more. {BSD[2]}") == [
        "MIT", "BSD-3-Clause", "BSD-2-Clause", "", "", "Apache-2.0", "", "MIT"]


def test_several_licenses_by_rule_and_once(make_docs):
    text = "All rights reserved.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT License."
    r, = licenses.scan(make_docs([(1, text)])).collect()
    assert r["licenses"] == "MIT,CC-BY-NC-4.0,All rights reserved"
    assert r["sentence_ids"] == "rights,cc-by-nc,mit-name,mit-name" and r["n_sentences"] == 4


def test_hard_rows(make_docs):
    out = rows_of(licenses.scan(make_docs(HARD)), "doc_id", "licenses", "n_sentences")
    assert out == sorted(((i, "", 0) for i, _ in HARD), key=repr)
    assert licenses.scan(make_docs([])).count() == 0


def test_tables_are_consistent():
    ids = {i for i, _ in licenses.SENTENCES}
    assert all(x in ids for _, sequence in licenses.RULES for x in sequence)
    assert len({s for _, s in licenses.SENTENCES}) == len(licenses.SENTENCES) <= 200
