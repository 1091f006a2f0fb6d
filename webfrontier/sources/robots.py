"""Robots files as rule tables, read by the rules of RFC 9309."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfrontier.functions.binding import let
from webfrontier.functions.urls import ascii_lower, strip_blanks
from webfrontier.operators.unnest import unnest

ANY_AGENT = "*"

# Field names to one-letter marks used while a file is cut into groups.
_MARKS = {"user-agent": "U", "allow": "A", "disallow": "D"}
_CUT = "\x01"


def _marked_lines(body: Column) -> Column:
    """The useful lines, each as its mark followed by its value, joined by newlines."""
    marks = F.create_map(*[F.lit(x) for pair in _MARKS.items() for x in pair])

    def mark(line: Column) -> Column:
        field = ascii_lower(strip_blanks(F.split_part(line, F.lit(":"), F.lit(1))))
        value = strip_blanks(F.substring(line, F.instr(line, ":") + F.lit(1), F.length(line)))
        return F.when(
            F.contains(line, F.lit(":")), F.concat(F.try_element_at(marks, field), value)
        )

    plain = F.regexp_replace(F.translate(body, _CUT, ""), r"\x{FEFF}|#[^\r\n]*", "")
    lines = F.transform(F.split(plain, r"\r\n|\r|\n"), mark)
    return F.array_join(F.filter(lines, lambda line: line.isNotNull()), "\n")


def _groups(body: Column) -> Column:
    """``array<struct<agents, rules>>``: a group starts at the first agent line after a rule line."""
    cut = F.regexp_replace(_marked_lines(body), r"(?m)^([AD][^\n]*)\n(?=U)", f"$1{_CUT}")

    def group(text: Column) -> Column:
        def split_lines(lines: Column) -> Column:
            agents = F.filter(lines, lambda line: F.startswith(line, F.lit("U")))
            rules = F.filter(
                lines, lambda line: ~F.startswith(line, F.lit("U")) & (F.length(line) > 1)
            )
            return F.struct(
                F.transform(agents, lambda line: ascii_lower(_value(line))).alias("agents"),
                F.transform(
                    rules,
                    lambda line: F.struct(
                        F.startswith(line, F.lit("A")).alias("allow"), _value(line).alias("pattern")
                    ),
                ).alias("rules"),
            )

        return let(F.split(text, "\n"), split_lines)

    return F.transform(F.split(cut, _CUT), group)


def _value(line: Column) -> Column:
    return F.substring(line, F.lit(2), F.length(line))


def robots_from_responses(responses: DataFrame, sites: DataFrame) -> DataFrame:
    """``(tag, host, body)`` of the sites whose ``/robots.txt`` was answered with code 200.

    ``responses`` is ``(tag, url, code, body)``. The body of another answer is no robots file, whatever it says. A missing body
    counts as an empty one; of several answers with code 200 the first by body is taken.
    """
    address = F.concat("scheme", F.lit("://"), "domain", F.lit("/robots.txt"))
    asked = sites.select("tag", F.col("domain").alias("host"), address.alias("url"))
    answers = responses.where((F.col("code") == 200) & F.endswith("url", F.lit("/robots.txt")))
    bodies = answers.groupBy("tag", "url").agg(F.min(F.coalesce("body", F.lit(""))).alias("body"))
    return asked.join(bodies, ["tag", "url"]).select("tag", "host", "body")


def parse_robots(robots: DataFrame) -> DataFrame:
    """``(tag, body)`` to one row per rule: ``(tag, block, agents, kind, pattern)``.

    Agents stay an array, so a group of many agents and many rules is not multiplied out.
    """
    numbered = F.transform(
        _groups(F.col("body")),
        lambda g, i: F.struct(i.alias("block"), g["agents"].alias("agents"), g["rules"].alias("rules")),
    )
    groups = unnest(robots, ["tag"], numbered).where(F.size("agents") > 0)
    return unnest(groups, ["tag", "block", "agents"], F.col("rules")).select(
        "tag",
        "block",
        "agents",
        F.when(F.col("allow"), F.lit("allow")).otherwise(F.lit("disallow")).alias("kind"),
        "pattern",
    )


def robots_policy(robots: DataFrame, agent: str = ANY_AGENT) -> DataFrame:
    """``(tag, robots_rules)``: the rules that hold for one agent, still one row per robots file."""

    def chosen(groups: Column) -> Column:
        def of(name: str) -> Column:
            return F.filter(groups, lambda g: F.array_contains(g["agents"], F.lit(name)))

        own = of(agent.lower())
        return F.when(F.size(own) > 0, own).otherwise(of(ANY_AGENT))

    def prepared(rule: Column) -> Column:
        """A rule with the pieces between its stars, and whether the last one must end the path."""
        ends = F.endswith(rule["pattern"], F.lit("$"))
        glob = F.when(ends, F.substring(rule["pattern"], F.lit(1), F.length(rule["pattern"]) - 1))
        return F.struct(
            rule["allow"].alias("allow"),
            F.octet_length(rule["pattern"]).alias("size"),
            F.split(F.coalesce(glob, rule["pattern"]), r"\*+").alias("pieces"),
            ends.alias("ends"),
        )

    rules = F.flatten(F.transform(let(_groups(F.col("body")), chosen), lambda g: g["rules"]))
    return robots.select("tag", F.transform(rules, prepared).alias("robots_rules"))


def _matches(path: Column, rule: Column) -> Column:
    """The first piece starts the path, and each other one is found at its first place behind the one before.

    That place leaves most room for what follows, so nothing is tried twice. The last piece of a rule
    that ends the path must close it behind all others.
    """
    pieces, count = rule["pieces"], F.size(rule["pieces"])
    first, last = pieces[0], F.element_at(pieces, -1)
    closing = rule["ends"] & (count > 1)
    middle = F.slice(pieces, F.lit(2), F.greatest(count - 1 - closing.cast("int"), F.lit(0)))

    def onward(at: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, path, at)
        return F.when((at == 0) | (found == 0), F.lit(0)).otherwise(found + F.length(piece))

    def closed(at: Column) -> Column:
        room = F.length(path) - at + 1 >= F.length(last)
        whole = F.when(closing, room & F.endswith(path, last)).otherwise(
            ~rule["ends"] | (F.length(path) == F.length(first))
        )
        return (at > 0) & whole

    return F.startswith(path, first) & let(F.aggregate(middle, F.length(first) + 1, onward), closed)


def robots_allow(path: Column, rules: Column) -> Column:
    """Whether the longest matching pattern allows the path; allow wins ties, no match allows."""
    best = F.array_max(
        F.transform(
            F.filter(rules, lambda rule: _matches(path, rule)),
            lambda r: F.struct(r["size"].alias("size"), r["allow"].alias("allow")),
        )
    )
    return F.coalesce(best["allow"], F.lit(True))
