"""Licence scans: Dice coefficient over word bigrams, with DataFrame functions only.

Each line of a text, and the text as a whole, is normalised (lower case, runs
of letters and digits) and compared to licence templates by the Dice coefficient
of their sets of word bigrams, 2 * both / (own + template).  A coefficient of at
least ``least`` needs sizes within a factor of (2 - least) / least of each other,
so templates outside those bounds are pruned before sets are compared, and
segments with too few words before their bigrams are made.

Windows of the whole text's words, as long as a template, find notices that are
wrapped over lines or stand inside longer ones, and whole licence texts
(``bodies``).  A window is laid wherever a bigram that a template has once stands
in its place.  A coefficient of ``least`` needs least / (2 - least) of the template's
bigrams, so texts with fewer of them, or without any of the few words that so many
bigrams can't do without, are pruned first.

One place has one licence: a segment counts for the template that it matches best (the last by
name of equal ones), of windows that overlap the best counts (the first of equals), and a window
doesn't count over a line that matches its template, or any other as well as the window does.

The templates are a parameter and part of the plan, so they are bounded:
``MOST_WORDS`` words in all.  All happens in a document's row; nothing is
shuffled and no row meets another.

Defined results: a null or empty text matches nothing; equal lines match each
time; repeated rows give equal rows; columns of the documents are kept.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

MOST_WORDS = 20_000

#: Short notices of well-known licences, as their texts ask for them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
}
#: Templates of more bigrams are looked for apart, in texts that are long enough for one of them.
LONG = 500
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, SMALL)))


def bigrams(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bodies() -> list[tuple[str, str]]:
    """(licence, text): whole licence texts, from the files beside this one; read by the driver."""
    return [(p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]


def _strings(values: list) -> Column:
    return F.split(F.lit("|".join(map(str, values))), r"\|")


def _window_table(templates: list[tuple[str, str]], lined: set[str]) -> Column:
    """Structs (licence, whether lines are compared to it, m words, b bigrams, a bigrams that show a place, o their offsets after a null)."""
    rows = []
    for licence, text in templates:
        w = words_of(text)
        run = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        once = [i for i, x in enumerate(run) if run.count(x) == 1]
        if 3 * len(once) <= len(set(run)):  # then a match might have none of them
            once = [i for i, x in enumerate(run) if run.index(x) == i]
        o = F.concat(F.array(F.lit(None).cast("int")), _strings(once).cast("array<int>"))
        rows.append(F.struct(F.lit(licence).alias("licence"), F.lit(text in lined).alias("lined"), F.lit(len(w)).alias("m"), _strings(bigrams(text)).alias("b"), _strings([run[i] for i in once]).alias("a"), o.alias("o")))
    return F.array(*rows)


def needed(text: str, least: float) -> list[str]:
    """Words of a template, long ones first, of which every match has at least one.

    A match has least / (2 - least) of the template's bigrams; the words are as
    many as it takes until fewer bigrams have none of them.
    """
    left, out = set(bigrams(text)), []
    most = least / (2 - least) * len(left) - 1e-9
    for w in sorted(set(words_of(text)), key=lambda w: (-len(w), w)):
        if len(left) < most:
            break
        rest = {b for b in left if w not in b.split(" ")}
        if len(rest) < len(left):
            left, out = rest, [*out, w]
    return out


def _in(array: str, values: set[str], function: str) -> Column:
    """``exists`` or ``filter`` of those elements that are among ``values`` (letters, digits and blanks), by a hash set in the plan."""
    return F.expr(f"{function}(`{array}`, x -> x in ({', '.join(repr(v) for v in sorted(values))}))")


def let(value: Column, f) -> Column:
    """``f(value)``, with the value worked out once."""
    return F.transform(F.array(value), f)[0]


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, least: float = 0.8, name: str = "licences") -> tuple[DataFrame, str]:
    """``docs`` and an array column (its name is the second result) of structs (licence, dice), one for each segment or window that matches a template."""
    given = TEMPLATES if templates is None else templates
    own = {k: b for k, t in given.items() if (b := bigrams(t))}
    laid = [(k, t) for k, t in [*given.items(), *(bodies() if templates is None else [])] if bigrams(t)]
    if sum(len(bigrams(t)) for _, t in laid) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    name = fresh(docs, name)
    nothing = F.expr("cast(array() as array<struct<licence string, dice double>>)")
    if not own:
        return docs.withColumn(name, nothing), name
    table = F.array(*[F.struct(F.lit(k).alias("licence"), F.array(*map(F.lit, b)).alias("b")) for k, b in own.items()])
    fewest, most = least / (2 - least) * min(map(len, own.values())), (2 - least) / least * max(map(len, own.values()))
    share = least / (2 - least) - 1e-9
    words = lambda s: F.filter(F.split(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    run = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    dice = lambda s, b: F.size(F.array_intersect(s, b)) * F.lit(2.0) / (F.size(s) + F.size(b))
    whole = F.coalesce(F.col(text), F.lit(""))

    # A text's words are made once; a text without any word that a match needs has no matches.
    all_words, some, pairs, hits = (fresh(docs, c) for c in ("words", "some", "pairs", "hits"))
    staged = docs.withColumn(all_words, words(whole))
    staged = staged.withColumn(some, _in(all_words, {w for _, t in laid for w in needed(t, least)}, "exists"))
    staged = staged.withColumn(pairs, F.when(F.col(some), run(F.col(all_words))))
    staged = staged.withColumn(hits, F.array_distinct(_in(pairs, {b for _, t in laid for b in bigrams(t)}, "filter")))

    pick = "struct<dice: double, licence: string>"
    at_most = lambda s, t: (F.size(s) * (2 - least) >= F.size(t["b"]) * least) & (F.size(t["b"]) * (2 - least) >= F.size(s) * least)

    def best(s: Column) -> Column:
        """The template that a set of bigrams matches best, the last by name of equal ones; null without any."""
        scored = F.transform(F.filter(table, lambda t: at_most(s, t)), lambda t: F.struct(dice(s, t["b"]).alias("dice"), t["licence"].alias("licence")))
        return F.array_max(F.filter(scored, lambda x: x["dice"] >= least))

    def segment(w: Column) -> Column:
        """The bigrams of a segment's words; none of one that is too short to match."""
        return F.when(F.size(w) - 1 >= max(1.0, fewest), F.array_distinct(run(w))).otherwise(F.array().cast("array<string>"))

    def judged(w: Column) -> Column:
        return let(segment(w), lambda s: F.when((F.size(s) > 0) & (F.size(s) <= most), best(s)).otherwise(F.lit(None).cast(pick)))

    last = lambda a: F.try_element_at(a, F.lit(-1))
    spot = "struct<at: int, end: int, bad: double, licence: string>"

    def windows(t: Column, lines: Column) -> Column:
        """Places of the whole text that match a template, but for those over a line that matches it or matches another as well."""
        p = F.col(pairs)
        at = F.filter(F.transform(p, lambda x, i: i - F.get(t["o"], F.array_position(t["a"], x).cast("int"))), lambda i: i.isNotNull())
        starts = F.array_distinct(F.transform(at, lambda i: F.greatest(i, F.lit(0))))
        scored = F.transform(starts, lambda i: F.struct(i.alias("at"), (i + t["m"]).alias("end"), (-dice(F.array_distinct(F.slice(p, i + 1, t["m"] - 1)), t["b"])).alias("bad"), t["licence"].alias("licence")))
        good = F.filter(scored, lambda x: x["bad"] <= -least)
        like = lambda s: at_most(s, t) & (dice(s, t["b"]) >= least)

        def covered(x: Column) -> Column:
            first = F.get(lines["of"], x["at"])
            n = F.get(lines["of"], F.least(x["end"], F.size(lines["of"])) - 1) - first + 1
            own = F.exists(F.slice(lines["sets"], first + 1, n), like) | like(lines["whole"])
            return (t["lined"] & own) | F.exists(F.slice(lines["best"], first + 1, n), lambda b: F.coalesce(b["dice"] >= -x["bad"], F.lit(False)))

        return F.filter(good, lambda x: ~covered(x))

    def apart(found: Column) -> Column:
        """Of windows that overlap, the best, the first of equals.  Those that overlap in a chain are decided together, so a notice that is repeated takes time in proportion."""
        chains = F.aggregate(F.array_sort(found), F.expr(f"cast(array() as array<array<{spot}>>)"), lambda got, x: F.when(last(last(got))["end"] > x["at"], F.concat(F.slice(got, F.lit(1), F.greatest(F.size(got) - 1, F.lit(0))), F.array(F.concat(last(got), F.array(x))))).otherwise(F.concat(got, F.array(F.array(x)))))
        order = lambda chain: F.array_sort(F.transform(chain, lambda x: F.struct(x["bad"].alias("bad"), x["at"].alias("at"), x["end"].alias("end"), x["licence"].alias("licence"))))
        kept_ = lambda chain: F.aggregate(order(chain), F.expr("cast(array() as array<struct<bad: double, at: int, end: int, licence: string>>)"), lambda got, x: F.when(F.exists(got, lambda y: (y["at"] < x["end"]) & (x["at"] < y["end"])), got).otherwise(F.concat(got, F.array(x))))
        return F.transform(F.flatten(F.transform(chains, lambda c: F.when(F.size(c) > 1, kept_(c)).otherwise(order(c)))), lambda x: F.struct(x["licence"].alias("licence"), (-x["bad"]).alias("dice")))

    def near(chosen) -> Column:
        """The templates that the text has enough bigrams of."""
        sets = [bigrams(t) for _, t in chosen]
        enough = lambda t: (F.size(hits) >= F.size(t["b"]) * share) & (F.size(F.array_intersect(t["b"], F.col(hits))) >= F.size(t["b"]) * share)
        table_ = _window_table(chosen, set(given.values()))
        return F.when(F.size(hits) >= min(map(len, sets)) * share, F.filter(table_, enough)).otherwise(F.filter(table_, lambda t: F.lit(False)))

    tiers = [t for far in (False, True) if (t := [x for x in laid if (len(bigrams(x[1])) > LONG) == far])]

    def all_of(words_: Column) -> Column:
        """Matches of the lines, of the whole text if it has several, and of windows."""
        bests = F.transform(words_, judged)
        whole_best = F.when(F.size(words_) > 1, judged(F.col(all_words)))

        def with_best(b: Column) -> Column:
            said = F.transform(F.filter(F.concat(b["lines"], F.array(b["whole"])), lambda x: x.isNotNull()), lambda x: F.struct(x["licence"].alias("licence"), x["dice"].alias("dice")))
            # A line's number for each word; bigrams of lines that may match.
            facts = F.struct(F.flatten(F.transform(words_, lambda w, k: F.transform(w, lambda _: k))).alias("of"), F.transform(words_, segment).alias("sets"), segment(F.col(all_words)).alias("whole"), b["lines"].alias("best"))

            def in_tier(ts: Column) -> Column:
                return F.when(F.size(ts) > 0, let(facts, lambda c: F.flatten(F.transform(ts, lambda t: windows(t, c))))).otherwise(F.expr(f"cast(array() as array<{spot}>)"))

            return F.concat(said, apart(F.concat(*[let(near(chosen), in_tier) for chosen in tiers])))

        return let(F.struct(bests.alias("lines"), whole_best.alias("whole")), with_best)

    result = F.when(F.col(some), let(F.transform(F.split(whole, "\n"), words), all_of)).otherwise(nothing)
    return staged.withColumn(name, result).select(*docs.columns, name), name


def report(docs: DataFrame) -> DataFrame:
    """One row per document: matching segments and windows, the licences by name, and the best coefficient (0 without any)."""
    found, name = scan(docs.select("doc_id", "text"))
    best = F.round(F.coalesce(F.array_max(F.col(f"{name}.dice")), F.lit(0.0)), 6)
    return found.select("doc_id", F.size(name).cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.col(f"{name}.licence"))), ",").alias("licences"), best.alias("best_dice"))


def sql() -> str:
    """The lines and whole texts in DuckDB's SQL, without windows."""
    table = ", ".join(f"('{k}', [{', '.join(repr(x) for x in bigrams(t))}])" for k, t in TEMPLATES.items())
    return f"""
    with templates(licence, b) as (values {table}),
    rows as (select row_number() over () as r, doc_id, text from documents),
    parts as (select r, case when contains(text, chr(10)) then list_append(string_split(text, chr(10)), text) else [text] end as p from rows where text is not null),
    segments as (select r, unnest(range(len(p))) as k, unnest(p) as s from parts),
    cut as (
      select r, k, list_filter(string_split(regexp_replace(translate(s, '{UPPER}', '{SMALL}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') as w from segments),
    sets as (
      select r, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as s from cut where len(w) > 1),
    scored as (
      select r, k, licence, 2.0::double * len(list_intersect(s, b)) / (len(s) + len(b)) as dice from sets, templates
      where len(s) * 1.2 >= len(b) * 0.8 and len(b) * 1.2 >= len(s) * 0.8),
    chosen as (select * from scored where dice >= 0.8 qualify row_number() over (partition by r, k order by dice desc, licence desc) = 1),
    hits as (
      select r, count(*)::bigint as n_matches, array_to_string(list_sort(list(distinct licence)), ',') as licences, round(max(dice), 6) as best_dice
      from chosen group by r)
    select d.doc_id, coalesce(n_matches, 0)::bigint as n_matches, coalesce(licences, '') as licences, coalesce(best_dice, 0.0)::double as best_dice
    from rows d left join hits using (r)
    """
