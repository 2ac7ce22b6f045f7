"""Licence scans over the licences' own wordings, unwrapped and wrapped."""

import textwrap

MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.',
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language.',
]
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
TEXTS = {
    "MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": [GPL3], "LGPL-2.1-or-later": [LGPL],
    "BSD-3-Clause": BSD, "MPL-2.0": [MPL], "ISC": [ISC],
}


def test_license_texts(spark):
    from lodestone.llm.licenses import scan

    rows = []
    for name, text in TEXTS.items():
        wrapped = [textwrap.fill(t, 64) for t in text]
        rows += [(name, "Some prose before.\n\n" + "\n\n".join(t) + "\n") for t in (text, wrapped)]
        rows.append((name, "\n".join(" * " + x for x in "\n\n".join(wrapped).split("\n"))))
        rows.append((name, "\r\n".join("\n\n".join(wrapped).split("\n"))))
    rows += [("MIT", " ".join(MIT)), ("Proprietary", "a line\nAll rights reserved\nanother line"), ("", "free\nsoftware")]
    df = spark.createDataFrame(rows, "name string, text string")
    for r in scan(df).collect():
        assert r["licenses"] == r["name"], (r["text"], r["sentence_ids"])


def test_columns_of_any_name_pass(spark):
    names = ["_ids", "a.b", "_row", "licenses", "ids"]
    rows = [(1, "Released under the MIT License.", *("x" * 5)), (2, None, *([None] * 5)), (3, "word " * 50_000, *("y" * 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    from lodestone.llm.licenses import scan

    got = {r["doc_id"]: r for r in scan(docs).collect()}
    assert list(got[1].asDict()) == ["doc_id", "text", "_ids", "a.b", "_row", "ids", "n_sentences", "sentence_ids", "licenses"]
    assert (got[1]["_ids"], got[1]["a.b"], got[1]["licenses"]) == ("x", "x", "MIT")
    assert got[2]["licenses"] == "" and got[3]["licenses"] == "" and scan(docs.limit(0)).isEmpty()
