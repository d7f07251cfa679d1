"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams, in DataFrame
operations only.

Compared are the lines of a text, its paragraphs of several lines, and the whole. Dice of two bags is
2 * common / (sum of sizes), so a template can match only if its size is within a ratio of the unit's; units and
templates outside are pruned by their number of words before a bigram is made.
"""

from pyspark.sql import DataFrame, functions as F

DICE = 0.8

# Licence notices, standard headers and short full texts, as their publishers word them. The SQL of op7 lists
# the same ones; it knows units of up to 400 words, so no template may be longer than 267 words.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
     " compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
     " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
     " on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for"
     " the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
     " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
     " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
     " to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
     " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)"
     " any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to"
     " this work."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
     " that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
     " not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU"
     " General Public License as published by the Free Software Foundation; either version 2 of the License, or"
     " (at your option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU"
     " Library General Public License as published by the Free Software Foundation; either version 2 of the"
     " License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU"
     " Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the"
     " License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
     " Lesser General Public License as published by the Free Software Foundation, either version 3 of the"
     " License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
     " Affero General Public License as published by the Free Software Foundation, either version 3 of the"
     " License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
     " associated documentation files (the \"Software\"), to deal in the Software without restriction, including"
     " without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
     " copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
     " following conditions: The above copyright notice and this permission notice shall be included in all"
     " copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF"
     " ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS"
     " FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE"
     " LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
     " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
     " hereby granted, provided that the above copyright notice and this permission notice appear in all"
     " copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
     " hereby granted, provided that the above copyright notice and this permission notice appear in all"
     " copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS"
     " SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR"
     " BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER"
     " RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER"
     " TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
     " that the following conditions are met: 1. Redistributions of source code must retain the above copyright"
     " notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must"
     " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
     " documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE"
     " COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT"
     " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
     " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,"
     " INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF"
     " SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED"
     " AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR"
     " OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF"
     " SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
     " that the following conditions are met: 1. Redistributions of source code must retain the above copyright"
     " notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must"
     " reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
     " documentation and/or other materials provided with the distribution. 3. Neither the name of the"
     " copyright holder nor the names of its contributors may be used to endorse or promote products derived"
     " from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT"
     " HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,"
     " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO"
     " EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
     " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE"
     " GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY"
     " THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
     " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
]


def normal_words(text: str) -> list[str]:
    """The words of a template: runs of letters and digits in lower case."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _words(s):
    return F.filter(F.split(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> DataFrame:
    """doc_id, license (that of the best match), dice, licenses (all matched, sorted, comma-joined), n_units (matched units).

    A unit matches a template at ``dice`` or more; equal best matches go to the first name in order. Units or templates of one word
    have no bigram and match nothing. A text without a match, NULL and empty ones among them, has NULL license and dice, no
    licenses and 0 units. Repeated rows are scanned alike; other columns are dropped. Nothing is shuffled.
    """
    kept = [(name, normal_words(text)) for name, text in templates]
    sizes = [len(w) - 1 for _, w in kept if len(w) > 1]
    schema = "doc_id {0}, license string, dice double, licenses string, n_units long".format(docs.schema["doc_id"].dataType.simpleString())
    if not sizes:
        return docs.select(F.from_json(F.lit("{}"), schema).alias("none"), "doc_id").select(
            "doc_id", "none.license", "none.dice", F.lit("").alias("licenses"), F.lit(0).cast("long").alias("n_units"))
    least, most = min(sizes) * dice / (2 - dice), max(sizes) * (2 - dice) / dice
    grams = F.array(*[F.struct(
        F.lit(name).alias("name"), F.lit(len(w) - 1).alias("size"),
        F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in zip(w, w[1:])]).alias("grams")) for name, w in kept if len(w) > 1])

    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.split(text, "\n").alias("lines"))
    paragraphs = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    whole = F.when(F.size("lines") > 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    units = base.select("doc_id", F.filter(F.transform(F.array_distinct(F.concat("lines", paragraphs, whole)), _words),
                                           lambda w: (F.size(w) - 1 >= least) & (F.size(w) - 1 <= most)).alias("units"))
    pairs = units.select("doc_id", F.transform("units", lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(w[i], w[i + 1]))).alias("units"))

    def matched(unit):
        def against(t):
            n = F.size(unit)
            common = F.aggregate(F.array_intersect(unit, t["grams"]), F.lit(0), lambda c, g: c + F.least(
                F.size(F.filter(unit, lambda x: x == g)), F.size(F.filter(t["grams"], lambda x: x == g))))
            fits = (n >= t["size"] * (dice / (2 - dice)) - 1e-9) & (n <= t["size"] * ((2 - dice) / dice) + 1e-9)
            return F.struct(F.when(fits, common.cast("double") * 2 / (n + t["size"])).otherwise(F.lit(0.0)).alias("dice"), t["name"].alias("name"))
        return F.filter(F.transform(F.col("templates"), against), lambda m: m["dice"] >= dice)

    found = (pairs.withColumn("templates", grams)
             .select("doc_id", F.filter(F.transform("units", matched), lambda m: F.size(m) > 0).alias("units"))
             .select("doc_id", F.size("units").cast("long").alias("n_units"), F.flatten("units").alias("all")))
    best = F.array_sort(F.transform("all", lambda m: F.struct((-m["dice"]).alias("minus"), m["name"].alias("name"))))
    found = found.select("doc_id", "n_units", best.alias("best"))
    return found.select(
        "doc_id", F.get("best", F.lit(0))["name"].alias("license"), (-F.get("best", F.lit(0))["minus"]).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("best", lambda m: m["name"]))), ",").alias("licenses"), "n_units")
