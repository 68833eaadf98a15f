"""License scans: phrases in place, and an exact set-similarity join with notices.

Words are runs of ASCII letters and digits and all other characters beyond ASCII, with
A-Z lower-cased. Base: the places where a phrase's words stand one after another. A license
that is only named (``NAMED``: "The MIT License") is no base place; the method finds it.

Method: text blocks are sets of words, matched with every notice whose words they hold to
``threshold`` or more (containment). Notices are put in one global order of words, the
rarest in the corpus first, and only blocks are verified that pass

* the prefix filter: they have one of the notice's first ``size - need + 1`` words;
* the positional filter: from such a word on, in the global order, block and notice both
  have ``need`` words left, so that the overlap can still reach ``need``;
* the length filter: ``need`` words of notices at least, and at most ``1 / threshold`` times
  the notice's words (windows; a line may be longer, see ``license_blocks``).

``scan`` takes as blocks all windows of consecutive words of the whole text, whatever line
ends lie between them. A window must also hold the words that tell the notice from others
(``NOTICES``): a sentence on some other license shares most of the words, but not those.
A window ends where it last gains a word of its notice. Where windows overlap, the one with the
best containment stays, of equal ones that of the longer notice, then the one that leaves the
notice's order of words least often, then the longest. A window that has to go itself holds
back no other, so notices that stand side by side are all found, also copies of one.

Texts are cut into segments of as many words as the longest window has, each with the
segment after it, so a row has a bounded size however long a text is. Notices are a fixed
list; only tables of that size are sent to all tasks, and blocks are never sent to each other.

Only DataFrame functions are used. Defined results: a null or empty text has no words, no
places and the score 0; null ids are kept; repeated rows get the same result each; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import materialize

THRESHOLD = 0.8

# Phrases with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Names of licenses, looked for in the same way. Each base phrase holds the name
# with its label, so a text's names have all its base labels.
NAMED = {
    "the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
PLACED = list(dict.fromkeys([*PHRASES, *NAMED]))

# Labels, words that tell the notice from others, and the words of notices and
# of whole licenses in common use.
NOTICES = [
    ("mit", "mit", "released under the mit license"),
    ("mit", "hereby charge", "permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files"),
    ("apache-2", "apache", "licensed under the apache license version 2 0"),
    ("gpl-3", "gnu 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu 2", "this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license version 2"),
    ("lgpl", "lesser", "licensed under the gnu lesser general public license"),
    ("agpl-3", "affero 3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "mozilla", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "commons sharealike", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "cc nc", "licensed under cc by nc 4 0"),
    ("cc0", "waived", "to the extent possible under law the author has waived all copyright and related rights"),
    ("mit", "hereby merchantability sublicense",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
     "notice and this permission notice shall be included in all copies or substantial portions of the software the "
     "software is provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
     "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
     "otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "hereby fee disclaims",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies the software is "
     "provided as is and the author disclaims all warranties with regard to this software including all implied "
     "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect "
     "or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
     "action of contract negligence or other tortious action arising out of or in connection with the use or "
     "performance of this software"),
    ("bsd-2", "redistribution binary exemplary",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met redistributions of source code must retain the above copyright notice this list of "
     "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
     "this list of conditions and the following disclaimer in the documentation and or other materials provided with "
     "the distribution this software is provided by the copyright holders and contributors as is and any express or "
     "implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
     "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct "
     "indirect incidental special exemplary or consequential damages including but not limited to procurement of "
     "substitute goods or services loss of use data or profits or business interruption however caused and on any "
     "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
     "way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3", "redistribution binary exemplary endorse",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met redistributions of source code must retain the above copyright notice this list of "
     "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
     "this list of conditions and the following disclaimer in the documentation and or other materials provided with "
     "the distribution neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission this software "
     "is provided by the copyright holders and contributors as is and any express or implied warranties including but "
     "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in "
     "no event shall the copyright holder or contributors be liable for any direct indirect incidental special "
     "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss "
     "of use data or profits or business interruption however caused and on any theory of liability whether in "
     "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this "
     "software even if advised of the possibility of such damage"),
    ("zlib", "misrepresented altered",
     "this software is provided as is without any express or implied warranty in no event will the authors be held "
     "liable for any damages arising from the use of this software permission is granted to anyone to use this software "
     "for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
     "following restrictions the origin of this software must not be misrepresented you must not claim that you wrote "
     "the original software if you use this software in a product an acknowledgment in the product documentation would "
     "be appreciated but is not required altered source versions must be plainly marked as such and must not be "
     "misrepresented as being the original software this notice may not be removed or altered from any source "
     "distribution"),
    ("unlicense", "unencumbered public domain",
     "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
     "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
     "commercial or non commercial and by any means"),
    ("apache-2", "apache warranties",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing "
     "software distributed under the license is distributed on an as is basis without warranties or conditions of any "
     "kind either express or implied see the license for the specific language governing permissions and limitations "
     "under the license"),
    ("gpl-2", "gnu 2 hope",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 2 of the license or at your option any later "
     "version this program is distributed in the hope that it will be useful but without any warranty without even the "
     "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for "
     "more details"),
    ("gpl-3", "gnu 3 hope",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later "
     "version this program is distributed in the hope that it will be useful but without any warranty without even the "
     "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for "
     "more details"),
    ("lgpl", "gnu lesser hope",
     "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license as published by the free software foundation either version 2 1 of the license or at your option "
     "any later version this library is distributed in the hope that it will be useful but without any warranty without "
     "even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general "
     "public license for more details"),
    ("agpl-3", "gnu affero hope",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
     "public license as published by the free software foundation either version 3 of the license or at your option "
     "any later version this program is distributed in the hope that it will be useful but without any warranty without "
     "even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general "
     "public license for more details"),
    ("mpl-2", "mozilla mpl",
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at"),
    ("bsl-1", "boost",
     "distributed under the boost software license version 1 0 see accompanying file or copy at"),
]
TEMPLATES = [(label, text) for label, _, text in NOTICES]
SIGNS = [signs.split() for _, signs, _ in NOTICES]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a lower-cased text."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def need_of(size: int, threshold: float) -> int:
    """Words a block has to share: the smallest whole number that reaches the threshold."""
    return next(k for k in range(size + 1) if k >= threshold * size - 1e-9)


def reach_of(text: str, threshold: float) -> int:
    """Words of a template's windows: its own ones are at least ``threshold`` of them."""
    return int(len(text.split()) / threshold + 1e-9)


def neighbours_of(text: str) -> list[tuple[str, str]]:
    """The pairs of words that follow one another in a template."""
    words = text.split()
    return sorted(set(zip(words, words[1:])))


def documents_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"),
                       lowered(F.col(f"`{text_col}`")).alias("text"))


def _stands_at(parts: list[str]):
    def test(i: Column) -> Column:
        found = F.get("words", i) == parts[0]
        for n in range(1, len(parts)):
            found = found & (F.get("words", i + n) == parts[n])
        return found

    return test


def phrase_places(rows: DataFrame) -> DataFrame:
    """``rows`` (id, mark, text) with n_words and one array of places per phrase or name."""
    worded = rows.select("id", "mark", words_of(F.col("text")).alias("words"))
    columns = []
    for k, phrase in enumerate(PLACED):
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), _stands_at(phrase.split()))
        # Most documents lack a phrase's last word: no walk through their words.
        columns.append(F.when(F.array_contains("words", phrase.split()[-1]), places).otherwise(
            F.expr("array()").cast("array<int>")).alias(f"places{k}"))
    return worded.select("id", "mark", F.size("words").cast("long").alias("n_words"), *columns)


class _Notices:
    """The notices with their words in global order: by the words' document frequency over
    all documents (one count for each of their words), the rarest first."""

    def __init__(self, docs: DataFrame, text_col: str, threshold: float):
        vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()})
        own = F.array_intersect(words_of(lowered(F.col(f"`{text_col}`"))), literal(vocabulary))
        counted = docs.select(F.explode(own).alias("word")).groupBy("word").count().collect()
        frequency = {r["word"]: r["count"] for r in counted}  # at most len(vocabulary) rows
        self.vocabulary = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
        rank = {w: k for k, w in enumerate(self.vocabulary)}
        self.words = [sorted(set(text.split()), key=rank.get) for _, text in TEMPLATES]
        self.need = [need_of(len(words), threshold) for words in self.words]
        self.reach = [reach_of(text, threshold) for _, text in TEMPLATES]
        self.prefix = [words[:len(words) - need + 1] for words, need in zip(self.words, self.need)]
        self.prefix_words = sorted({w for words in self.prefix for w in words})
        self.most = max(self.reach)

    def candidates(self, words: Column, own: Column, signs: bool) -> Column:
        """The numbers of the notices that a block may hold; ``own``: its words of notices in
        global order. With ``signs``, only those whose telling words it has."""
        tests = []
        for k, (prefix, need) in enumerate(zip(self.prefix, self.need)):
            size = len(self.words[k])
            # From the first shared prefix word on, both sides still have enough words.
            first = F.element_at(F.array_intersect(own, literal(prefix)), 1)
            left = F.size(own) - F.array_position(own, first) + 1
            test = F.arrays_overlap(own, literal(prefix)) & (
                F.least(left, size - F.array_position(literal(self.words[k]), first) + 1) >= need)
            if signs:
                has = [F.array_contains(own, word) for word in SIGNS[k]]
                for more in has[1:]:
                    has[0] = has[0] & more
                test = has[0] & test
            tests.append(F.when(test, F.lit(k)))
        return F.array_compact(F.array(*tests))

    def table(self, spark) -> DataFrame:
        """One row for each notice: a fixed number of rows."""
        return spark.createDataFrame(
            [(k, label, words, need, reach, SIGNS[k],
              [[words.index(b) + 1 for a, b in neighbours_of(text) if a == word] for word in words])
             for k, ((label, text), words, need, reach) in enumerate(zip(TEMPLATES, self.words, self.need, self.reach))],
            "template int, label string, template_words array<string>, need int, reach int, signs array<string>, "
            "followers array<array<long>>")


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """Every (id, mark, block, template, label, containment) of lines that meet the threshold;
    ``mark`` is a hash of the text and ``block`` the number of the line. Lines have no upper
    length here, and no telling words are asked for: the plain join."""
    notices = _Notices(docs, text_col, threshold)
    blocks = documents_words(docs, id_col, text_col).select(
        "id", "mark", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    sets = blocks.select("id", "mark", "block", words_of(F.col("line")).alias("words")).where(
        F.arrays_overlap("words", literal(notices.prefix_words)))
    own = sets.withColumn("own", F.array_intersect(literal(notices.vocabulary), F.col("words")))
    met = own.select("id", "mark", "block", "own", F.explode(
        notices.candidates(F.col("words"), F.col("own"), False)).alias("template"))
    shared = F.size(F.array_intersect("own", "template_words"))
    return met.join(F.broadcast(notices.table(docs.sparkSession)), "template").where(shared >= F.col("need")).select(
        "id", "mark", "block", "template", "label", (shared / F.size("template_words")).alias("containment"))


def _windows(docs: DataFrame, id_col: str, text_col: str, notices: _Notices, signs: bool) -> DataFrame:
    """Every (id, mark, template, label, size, start, end, breaks, containment) of windows that
    meet the threshold; a window starts with a word of its notice, and ``end`` is the place of
    the last word that is new in it. ``breaks``: its words that another word follows than in
    the notice."""
    most = notices.most
    worded = documents_words(docs, id_col, text_col).select("id", "mark", words_of(F.col("text")).alias("words"))
    # Most texts lack any prefix word, or any notice's telling words.
    possible = F.arrays_overlap("words", literal(notices.prefix_words))
    if signs:
        telling = [F.array_contains("words", s[0]) for s in SIGNS]
        any_sign = telling[0]
        for test in telling[1:]:
            any_sign = any_sign | test
        possible = possible & any_sign
    # Segments of ``most`` words with the segment after them: a bounded row each.
    count = F.ceil(F.size("words") / most).cast("int")
    segments = worded.where(possible).select("id", "mark", F.posexplode(F.transform(
        F.sequence(F.lit(0), count - 1), lambda k: F.slice("words", k * most + 1, 2 * most))).alias("segment", "words"))
    own = segments.withColumn("own", F.array_intersect(literal(notices.vocabulary), F.col("words"))).where(
        F.arrays_overlap("own", literal(notices.prefix_words)))
    met = own.select("id", "mark", "segment", "words", F.explode(
        notices.candidates(F.col("words"), F.col("own"), signs)).alias("template"))
    known = met.join(F.broadcast(notices.table(docs.sparkSession)), "template")
    # Places of the notice's words, with the word's number in the notice.
    hits = F.filter(F.transform("words", lambda w, i: F.struct(
        i.alias("place"), F.array_position("template_words", w).alias("word"))), lambda h: h["word"] > 0)
    placed = known.withColumn("hits", hits).drop("words", "own")

    def window(h: Column, i: Column) -> Column:
        """The hits of the window that starts here, if they can be enough."""
        inside = F.filter(F.slice("hits", i + 1, F.col("reach")), lambda o: o["place"] < h["place"] + F.col("reach"))
        return F.when((h["place"] < most) & (
            F.get("hits", i + F.col("need") - 1)["place"] < h["place"] + F.col("reach")), inside)

    opened = placed.select("id", "mark", "segment", "template", "label", "template_words", "need", "signs", "followers", F.explode(
        F.array_compact(F.transform("hits", window))).alias("w")).withColumn(
        "numbers", F.transform("w", lambda o: o["word"])).withColumn("held", F.array_distinct("numbers")).where(
        F.size("held") >= F.col("need"))
    if signs:
        opened = opened.where(F.forall("signs", lambda s: F.array_contains(
            "numbers", F.array_position("template_words", s))))
    opened = opened.withColumn("new", F.array_max(F.transform("held", lambda n: F.array_position("numbers", n))).cast("int"))
    first, last = F.get("w", F.lit(0))["place"], F.get("w", F.col("new") - 1)["place"]
    after = lambda i: F.get("w", i + 1)
    in_order = F.size(F.filter(F.slice("w", F.lit(1), F.col("new") - 1), lambda o, i: (
        after(i)["place"] == o["place"] + 1) & F.array_contains(
            F.get("followers", (o["word"] - 1).cast("int")), after(i)["word"])))
    base = F.col("segment") * most
    size = F.size("template_words")
    return opened.select("id", "mark", "template", "label", size.alias("size"), (base + first).alias("start"),
                         (base + last).alias("end"), (last - first - in_order).alias("breaks"),
                         (F.size("held") / size).alias("containment"))


def license_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Every (id, mark, template, label, containment) of windows over the whole text that
    meet the threshold, telling words or not; the best of each text and notice."""
    rows = _windows(docs, id_col, text_col, _Notices(docs, text_col, threshold), False)
    return rows.groupBy("id", "mark", "template", "label").agg(F.max("containment").alias("containment"))


def _judged(windows: DataFrame, most: int) -> DataFrame:
    """One round: windows with ``stays``, without those that overlap a better one that stays.

    A window stays if all that it overlaps are worse or as good. Only windows that start
    within ``most`` words of each other can overlap."""
    near = Window.partitionBy("id", "mark").orderBy("start").rangeBetween(-most, most)
    better = lambda others: F.exists(others, lambda o: (
        o["start"] <= F.col("end")) & (F.col("start") <= o["end"]) & (o["rank"] > F.col("rank")))
    own = F.struct("start", "end", "rank")
    first = windows.withColumn("others", F.collect_list(own).over(near)).withColumn(
        "stays", ~better("others")).drop("others")
    return first.withColumn("others", F.collect_list(F.when(F.col("stays"), own)).over(near)).where(
        ~better("others")).drop("others")


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """(id, mark, template, label, start, end, containment) of the notices that stand in the
    texts, after overlaps are settled; words are counted from 0."""
    notices = _Notices(docs, text_col, threshold)
    # Repeated rows have the same windows.
    rank = F.struct("containment", "size", (-F.col("template")).alias("template"), (-F.col("breaks")).alias("breaks"),
                    (F.col("end") - F.col("start")).alias("length"))
    open_ = _windows(docs, id_col, text_col, notices, True).distinct().withColumn("rank", rank)
    kept = []
    # A round settles every window that no chain of better ones leads to. Ranks are bounded by
    # the notices, so the longest chain is, however long a text is.
    while True:
        judged = materialize(_judged(open_, notices.most), "license-windows")
        kept.append(judged.where("stays"))
        open_ = judged.where(~F.col("stays")).drop("stays")
        if open_.isEmpty():
            break
    stay = kept[0]
    for more in kept[1:]:
        stay = stay.union(more)
    # Windows of one notice that are as good and overlap count once, by the first.
    order = Window.partitionBy("id", "mark", "template").orderBy("start")
    again = F.coalesce(F.lag("end").over(order) >= F.col("start"), F.lit(False))
    return stay.withColumn("again", again).where(~F.col("again")).select(
        "id", "mark", "template", "label", "start", "end", "containment")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = THRESHOLD, named: bool = False) -> DataFrame:
    """Per document id, n_words, n_base, first_word, last_word, base_labels, labels, score;
    with ``named`` also n_named, first_named, last_named, the same for the places of names.

    ``score``: 1 with a name (a base label is one), else the best containment among the
    matches, or 0.
    """
    placed = phrase_places(documents_words(docs, id_col, text_col))

    def places(phrases: dict[str, str]) -> tuple[Column, Column]:
        """All places of the phrases, and the labels of those that the text has."""
        names = [f"places{PLACED.index(phrase)}" for phrase in phrases]
        labels = F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values())])
        return F.flatten(F.array(*names)), F.array_sort(F.array_distinct(F.array_compact(labels)))

    (every, base_labels), (every_name, name_labels) = places(PHRASES), places(NAMED)
    base = placed.select(
        "id", "mark", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        base_labels.alias("base"), F.size(every_name).cast("long").alias("n_named"),
        F.array_min(every_name).cast("long").alias("first_named"),
        F.array_max(every_name).cast("long").alias("last_named"), name_labels.alias("names"))
    found = matches(docs, id_col, text_col, threshold).groupBy(
        F.col("id").alias("own_id"), F.col("mark").alias("own_mark")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    rows = base.join(found, base.id.eqNullSafe(found.own_id) & (base.mark == found.own_mark), "left")
    more = F.coalesce("more", F.expr("array()").cast("array<string>"))
    return rows.select(
        "id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("names", more)), ",").alias("labels"),
        F.when(F.size("names") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        *(["n_named", "first_named", "last_named"] if named else []))


def wrapped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with a notice each at their end, wrapped over lines and without one word."""
    k = F.pmod(F.col(id_col), F.lit(len(TEMPLATES))).cast("int")
    notice = F.replace(F.element_at(literal(wrapped_notices()), k + 1), F.lit(" the "), F.lit("\n * the "))
    return docs.select(id_col, F.concat(F.coalesce(text_col, F.lit("")), F.lit("\n"), notice).alias(text_col))


def wrapped_notices() -> list[str]:
    """The notices without their fifth word."""
    return [" ".join(w for k, w in enumerate(text.split()) if k != 4) for _, text in TEMPLATES]


def wrapped_sql() -> str:
    """``wrapped`` as SQL."""
    return (f"SELECT doc_id, coalesce(text, '') || chr(10) || replace(({wrapped_notices()!r})"
            f"[1 + doc_id % {len(TEMPLATES)}], ' the ', chr(10) || ' * the ') AS text FROM documents")


def oracle(threshold: float = THRESHOLD, source: str = "SELECT doc_id, text FROM documents",
           named: bool = False) -> str:
    """DuckDB SQL: every window of every text that holds a notice's telling words; the best
    stays, then the best of those that it does not overlap, and so on."""
    places = []
    for phrase in PLACED:
        parts = phrase.split()
        test = " and ".join(f"w[i + {n + 1}] = '{part}'" for n, part in enumerate(parts))
        places.append(f"list_filter(range(0, len(w)), lambda i: {test})")
    lists, names = ([f"p{PLACED.index(phrase)}" for phrase in phrases] for phrases in (PHRASES, NAMED))
    labels = lambda columns, phrases: "list_filter([{}], lambda x: x IS NOT NULL)".format(", ".join(
        f"CASE WHEN len({n}) > 0 THEN '{label}' END" for n, label in zip(columns, phrases.values())))
    last = ", n_named, first_named, last_named" if named else ""
    templates = ", ".join(
        f"({k}, '{label}', {sorted(set(text.split()))!r}, {need_of(len(set(text.split())), threshold)}, "
        f"{reach_of(text, threshold)}, {SIGNS[k]!r}, "
        f"{[' '.join(pair) for pair in neighbours_of(text)]!r})" for k, (label, text) in enumerate(TEMPLATES))
    words = f"list_filter(regexp_split_to_array({{}}, '{SEPARATORS}'), lambda x: x <> '')"
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH templates(template, label, words, need, reach, signs, neighbours) AS (VALUES {templates}),
docs AS (SELECT row_number() OVER () AS row, doc_id, {low} AS t FROM ({source})),
worded AS (SELECT row, doc_id, {words.format('t')} AS w FROM docs),
placed AS (SELECT row, doc_id, len(w) AS n_words, {', '.join(f'{p} AS p{k}' for k, p in enumerate(places))}
           FROM worded),
near AS (SELECT row, w, templates.* FROM worded, templates WHERE list_has_all(w, signs)),
opened AS (SELECT row, template, label, words, need, signs, neighbours, start, w[start + 1:start + reach] AS held
           FROM (SELECT *, unnest(list_filter(range(0, len(w)), lambda i: list_contains(words, w[i + 1]))) AS start
                 FROM near)),
found AS (SELECT *, len(list_intersect(list_distinct(held), words)) / len(words) AS containment, list_max(list_transform(
                 list_filter(words, lambda x: list_contains(held, x)), lambda x: list_position(held, x))) AS length
          FROM opened WHERE list_has_all(held, signs) AND len(list_intersect(list_distinct(held), words)) >= need),
windows AS (SELECT row, label, start, start + length - 1 AS stop,
                   {{'containment': containment, 'size': len(words), 'template': -template, 'follow': -len(list_filter(
                     range(1, length), lambda i: NOT list_contains(neighbours, held[i] || ' ' || held[i + 1]))),
                     'length': length}} AS rank FROM found),
kept AS (SELECT row, unnest(list_reduce(list([w] ORDER BY w.rank DESC), lambda k, x: CASE WHEN len(list_filter(
           k, lambda o: o.start <= x[1].stop AND x[1].start <= o.stop AND o.rank > x[1].rank)) = 0
           THEN k || x ELSE k END)) AS w FROM (SELECT row, windows AS w FROM windows) GROUP BY row),
more AS (SELECT row, list(DISTINCT w.label) AS more, max(w.rank.containment) AS best FROM kept GROUP BY row),
base AS (SELECT row, doc_id, n_words, {' || '.join(lists)} AS every, {labels(lists, PHRASES)} AS base,
                {labels(names, NAMED)} AS names, len({' || '.join(names)}) AS n_named,
                list_min({' || '.join(names)}) AS first_named, list_max({' || '.join(names)}) AS last_named
         FROM placed)
SELECT doc_id, n_words, len(every) AS n_base, list_min(every) AS first_word, list_max(every) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(names || coalesce(more, []))), ','), '') AS labels,
       CASE WHEN len(names) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score{last}
FROM base LEFT JOIN more USING (row)"""
