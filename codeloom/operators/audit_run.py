"""Checks of an audit run across its tables, and the revisions that are kept of runs.

A run has *units* of coverage, each of which an agent worked on in waves; the agent's *checks* read paths and may leave an artifact; units and
earlier *attempts* at them end in a status.  *Findings* name places in the source, and *reviews* repeat confirmed findings.  ``manifest(path, lines)`` is the source
the run looked at.  Every check gives rows ``violation, id``; none holds more than the arrays of one unit in a row.

``units(unit, status, owner, wave, reviewed array<string>, checks array<struct<agent, paths array<string>, artifact>>, results array<string>, unresolved array<string>,
attempts array<struct<wave, status, owner, reviewed, checks, results, unresolved>>)``
"""

from __future__ import annotations

from codeloom.operators.ledger import failing
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per status what an owner (+ one, - none), reviewed paths, checks, unresolved questions and results must be: + some, - none, * either.
STATES = {
    "planned": "-----", "not_applicable": "---+-", "out_of_scope": "---+-", "deferred": "---+-", "in_progress": "+----",
    "blocked": "++++-", "covered": "+++--", "candidate": "+++*+",
}
#: The status that an attempt may end in.
ATTEMPT_STATES = ("covered", "candidate", "blocked")
_PARTS = ("owner", "reviewed", "checks", "unresolved", "results")


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def state_violations(row: Column, states: tuple[str, ...] = tuple(STATES)) -> Column:
    """What a unit or attempt (a struct) breaks of its status, as an array of names."""
    some = {p: (row[p].isNotNull() & (F.trim(row[p]) != "")) if p == "owner" else _size(row[p]) > 0 for p in _PARTS}
    found = [F.when(~F.coalesce(row["status"].isin(*states), F.lit(False)), "unknown status")]
    for n, part in enumerate(_PARTS):
        needs = [s for s in states if STATES[s][n] == "+"]
        bars = [s for s in states if STATES[s][n] == "-"]
        found += [F.when(row["status"].isin(*needs) & ~some[part], f"no {part}"), F.when(row["status"].isin(*bars) & some[part], f"{part} not allowed")]
    return F.filter(F.array(*found), lambda v: v.isNotNull())


def ownership_violations(row: Column) -> Column:
    """Paths that were reviewed without a check, or checked without being counted as reviewed."""
    checked = F.flatten(F.transform(F.coalesce(row["checks"], F.array()), lambda c: c["paths"]))
    reviewed = F.coalesce(row["reviewed"], F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    free = F.transform(F.coalesce(F.array_except(reviewed, checked), none), lambda p: F.concat(F.lit("no check reads "), p))
    more = F.transform(F.coalesce(F.array_except(checked, reviewed), none), lambda p: F.concat(F.lit("not counted as reviewed: "), p))
    return F.concat(free, more)


def unit_errors(units: DataFrame) -> DataFrame:
    """``violation, id`` of units and their attempts: status, owners of paths, order of waves, owners and artifacts that come back.

    An agent takes a unit once; a later attempt, or the current one, has another, leaves its predecessors' checks where they are, and reuses no artifact.
    """
    now = F.struct("status", "owner", "wave", "reviewed", "checks", "results", "unresolved")
    every = F.concat(F.transform(F.coalesce("attempts", F.array().cast(units.schema["attempts"].dataType)), lambda a: F.struct(*[a[f].alias(f) for f in ("status", "owner", "wave", "reviewed", "checks", "results", "unresolved")])), F.array(now))
    rows = units.select(F.col("unit").alias("id"), F.posexplode(every).alias("at", "a"), (F.size(every) - 1).alias("last"))
    current = F.col("at") == F.col("last")
    a = F.col("a")
    found = F.concat(F.when(current, state_violations(a)).otherwise(state_violations(a, ATTEMPT_STATES)), ownership_violations(a))
    own = rows.select("id", F.explode(found).alias("violation"))

    each = units.select(F.col("unit").alias("id"), every.alias("every"))
    before = F.transform(F.col("every"), lambda x, n: F.struct(x.alias("now"), F.slice(F.col("every"), F.lit(1), n).alias("past")))
    tries = each.select("id", F.explode(before).alias("t")).select("id", F.col("t.now").alias("now"), F.col("t.past").alias("past"))
    owners = F.transform("past", lambda p: p["owner"])
    artifacts = F.flatten(F.transform("past", lambda p: F.transform(F.coalesce(p["checks"], F.array()), lambda c: c["artifact"])))
    checks = F.coalesce(F.col("now.checks"), F.array())
    rules = {
        "waves do not grow": F.col("now.wave") > F.coalesce(F.array_max(F.transform("past", lambda p: p["wave"])), F.lit(0)),
        "owner comes back": ~F.coalesce(F.array_contains(owners, F.col("now.owner")), F.lit(False)),
        "check of an earlier owner": ~F.exists(checks, lambda c: F.coalesce(F.array_contains(owners, c["agent"]), F.lit(False))),
        "artifact comes back": ~F.exists(checks, lambda c: F.coalesce(F.array_contains(artifacts, c["artifact"]), F.lit(False))),
    }
    return own.select("violation", "id").unionByName(failing(tries, "id", rules))


def evidence_errors(places: DataFrame, manifest: DataFrame) -> DataFrame:
    """``violation, id, file, line`` of ``places(id, file, line)`` that are not in the source: another file, or a line it does not have.

    ``manifest(path, lines)`` has a path once.  A null line is a place without one if ``id`` only names the file, so give paths by ``paths_of``.
    Distinct places are looked up, so that a file named very often is joined once a line.
    """
    asked = places.select("file", "line").distinct()
    known = asked.join(manifest.select(F.col("path").alias("file"), "lines"), "file", "left")
    outside = F.col("line").isNotNull() & ~F.col("line").between(1, F.col("lines"))
    wrong = known.withColumn("violation", F.when(F.col("lines").isNull(), "file outside the snapshot").when(outside, "line outside the file")).filter("violation is not null")
    here = places.select("id", F.col("file").alias("f"), F.col("line").alias("l"))
    return here.join(wrong, F.col("f").eqNullSafe(F.col("file")) & F.col("l").eqNullSafe(F.col("line"))).select("violation", "id", "file", "line")


def paths_of(units: DataFrame) -> DataFrame:
    """``id, file, line`` of all paths that units and their checks name; the line is null."""
    checked = F.flatten(F.transform(F.coalesce("checks", F.array()), lambda c: c["paths"]))
    named = F.array_union(F.coalesce("reviewed", F.array().cast("array<string>")), F.coalesce(checked, F.array().cast("array<string>")))
    return units.select(F.col("unit").alias("id"), F.explode(named).alias("file"), F.lit(None).cast("long").alias("line"))


def link_errors(units: DataFrame, findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """``violation, id``: findings and results of units must be the same; reviews name one finding each, once.

    A confirmed finding's review must be by an agent that owns no unit with the finding, of a discoverer that owns one.
    ``findings(fingerprint, verdict)``, ``reviews(fingerprint, discoverer, verifier)``
    """
    linked = units.select("owner", F.explode("results").alias("fingerprint")).distinct()
    known = findings.select("fingerprint").distinct()

    def rows(found: DataFrame, violation: str) -> DataFrame:
        return found.select(F.lit(violation).alias("violation"), F.col("fingerprint").alias("id"))

    out = rows(linked.select("fingerprint").distinct().join(known, "fingerprint", "left_anti"), "result without finding")
    out = out.unionByName(rows(known.join(linked, "fingerprint", "left_anti"), "finding without unit"))
    out = out.unionByName(rows(reviews.join(known, "fingerprint", "left_anti").select("fingerprint").distinct(), "review without finding"))
    out = out.unionByName(rows(reviews.groupBy("fingerprint").count().filter("count > 1"), "reviewed twice"))
    confirmed = findings.filter("verdict = 'confirmed'").select("fingerprint").distinct()
    out = out.unionByName(rows(confirmed.join(reviews, "fingerprint", "left_anti"), "not reviewed"))
    pairs = confirmed.join(reviews, "fingerprint").select("fingerprint", "discoverer", "verifier")
    owned = linked.withColumn("owns", F.lit(True))

    def owner(name: str) -> DataFrame:
        return owned.select("fingerprint", F.col("owner").alias(name), F.col("owns").alias(f"{name}_owns"))

    placed = pairs.join(owner("discoverer"), ["fingerprint", "discoverer"], "left").join(owner("verifier"), ["fingerprint", "verifier"], "left")
    own = placed.filter(F.col("verifier_owns").isNotNull() | F.col("verifier").eqNullSafe(F.col("discoverer")))
    out = out.unionByName(rows(own.select("fingerprint").distinct(), "reviewed by its discoverer"))
    return out.unionByName(rows(placed.filter("discoverer_owns is null").select("fingerprint").distinct(), "discovered by somebody without the unit"))


REVISIONS = "project string, revision string, run string, snapshot string, status string, number long, latest boolean"


def import_runs(kept: DataFrame, runs: DataFrame) -> DataFrame:
    """``kept`` (``REVISIONS``) with the runs ``project, run, snapshot, status, json`` that it lacks.

    A revision is the hash of a run's content, and is kept once.  New ones are numbered on from the largest number of their project, in the order of ``arrived``;
    the run that arrived last is the project's latest revision, known before or not.
    """
    from codeloom.operators.prefix import ordinals

    named = runs.withColumn("revision", F.sha2("json", 256))
    first = named.groupBy("project", "revision").agg(F.min_by(F.struct("run", "snapshot", "status"), "arrived").alias("r"), F.min("arrived").alias("arrived"))
    fresh = first.join(kept.select("project", "revision"), ["project", "revision"], "left_anti")
    most = kept.groupBy("project").agg(F.max("number").alias("most"))
    numbered = ordinals(fresh, ["project"], [F.col("arrived"), F.col("revision")], "n").join(most, "project", "left")
    new = numbered.select("project", "revision", "r.run", "r.snapshot", "r.status", (F.col("n") + F.coalesce("most", F.lit(0))).alias("number"))
    newest = named.groupBy("project").agg(F.max_by("revision", "arrived").alias("newest"))
    before = kept.filter("latest").select("project", F.col("revision").alias("old"))
    latest = newest.join(before, "project", "full_outer").select("project", F.coalesce("newest", "old").alias("now"))
    every = kept.drop("latest").unionByName(new).join(latest, "project", "left")
    return every.select("project", "revision", "run", "snapshot", "status", "number", F.coalesce(F.col("revision") == F.col("now"), F.lit(False)).alias("latest"))


def history(revisions: DataFrame, project: str, size: int) -> DataFrame:
    """The newest ``size`` revisions of a project, newest first, each with ``has_more``: whether there are others."""
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 revisions")
    found = revisions.filter(F.col("project") == project).orderBy(F.desc("number")).limit(size + 1)
    more = F.array_agg(F.struct(F.col("number").alias("number"), *[F.col(c) for c in found.columns if c != "number"]))
    page = found.agg(F.reverse(F.array_sort(more)).alias("p"), (F.count(F.lit(1)) > size).alias("has_more"))  # at most 101 rows
    return page.select(F.posexplode(F.slice("p", 1, size)).alias("position", "r"), "has_more").select("position", "r.*", "has_more").orderBy("position")
