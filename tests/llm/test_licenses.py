"""Licence texts as they occur: wrapped, in comments, with list numbers."""

import textwrap

from braidlake.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
WANT = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL.replace("version 3", "version 2"), "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3}


def test_whole_licences(spark):
    rows = []
    for name, text in WANT.items():
        lines = [x for p in text.split("\n\n") for x in [*textwrap.wrap(p, 70), ""]]
        for mark in ("", " * ", "# ", "// "):
            rows.append((len(rows), name, "int x;\n" + "\n".join(mark + x for x in lines) + "\nmain\n"))
        rows.append((len(rows), name, text))
    df = spark.createDataFrame(rows, "doc_id long, name string, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for i, name, _ in rows:
        assert got[i]["license"] == name, (name, got[i])
    twice = spark.createDataFrame([(0, MIT + "\n\n" + MIT), (1, MIT.replace("and/or sell", "but not sell"))], "doc_id long, text string")
    ids = {r["doc_id"]: (r["sentence_ids"], r["license"]) for r in licenses.license_scan(twice).collect()}
    assert ids[0] == ("mit-grant,mit-notice,mit-asis,mit-grant,mit-notice,mit-asis", "MIT") and ids[1][1] is None
