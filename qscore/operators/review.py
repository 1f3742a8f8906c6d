"""Model reviews: pack, redact, request, parse, merge."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window, functions as F

from qscore import constants as K, schemas
from qscore.functions import paths
from qscore.functions.strict_json import strict
from qscore.functions.text import once, scrub, trim_space
from qscore.operators.fetch import likely
from qscore.operators.scoring import total
from qscore.operators.skew import first_rows, join_few
from qscore.shared import materialize
from qscore.sources.files import exclude_by_policy, exclusion_rules

# ---------------------------------------------------------------------------- packing
# A header alone has nine bytes and a file adds a line feed, so no more files than this
# can be looked at before the budget is spent.
_LEAST_BYTES = len("=== ") + len(" ===\n") + 1


def pack_payload(
    files: DataFrame,
    key: str = "repo",
    name: str = "path",
    order: Sequence[Column] | None = None,
    content: str = "content",
    allowed: DataFrame | None = None,
    cap: int = K.PAYLOAD_BYTES,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    listed: str | None = None,
) -> DataFrame:
    """(key, payload, n_files, is_truncated): files in order, as many as the cap holds; ``listed`` adds a column
    of that name with the names of the files in the payload.

    Packing stops at the first file that does not fit; a marker says so. The line feed
    after a file is not part of the test. The cut is found on byte lengths and written;
    only the content of kept files is fetched afterwards. ``allowed`` (key) restricts the keys:
    the content of others is never fetched. ``keep`` filters the rows (key, ``name`` and a size)
    before anything is packed.
    No key with very many files is ever sorted as a whole: after cap / 10 files the
    budget is spent whatever their content, so later ones cannot be kept.
    """
    order = list(order) if order is not None else [paths.walk_order(F.col(name))]
    header = F.concat(F.lit("=== "), F.col(name).cast("string"), F.lit(" ===\n"))
    sizes = files.where(F.col(content).isNotNull()).select(
        key,
        name,
        *[o.alias(f"_o{i}") for i, o in enumerate(order)],
        (F.octet_length(header) + F.octet_length(content)).cast("long").alias("_size"),
    )
    if keep is not None:
        # Written once, as a filter by rules reads its rows several times: names and sizes, no content.
        sizes = keep(materialize(sizes, "payload-sizes"))
    sort = [F.col(f"_o{i}") for i in range(len(order))]
    head = first_rows(sizes, [key], sort, cap // _LEAST_BYTES + 2, spread=(name,), only=allowed)
    before = Window.partitionBy(key).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    # Kept files and the first that does not fit have at most cap + 1 bytes before them.
    near_cut = head.withColumn(
        "_before", F.coalesce(F.sum(F.col("_size") + 1).over(before), F.lit(0))
    ).where(F.col("_before") <= cap + 1)
    fits = F.col("_before") + F.col("_size") <= cap
    cut = materialize(near_cut.select(key, name, "_before", fits.alias("_fits")), "payload-cuts")
    kept = cut.where("_fits").select(key, name, "_before")
    # Whatever is sent to the tasks, content of files that are not kept does not move.
    body = likely(files.where(F.octet_length(content) <= cap), kept, (key, name)).select(
        key, name, F.concat(header, F.col(content), F.lit("\n")).alias("_text")
    )
    # Bounded groups: at most cap bytes of text per key.
    texts = (
        body.join(kept, [key, name])
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_before", "_text"))).alias("_parts"))
    )
    counts = [F.count_if("_fits").cast("int").alias("n_files"), F.bool_or(~F.col("_fits")).alias("is_truncated")]
    if listed:
        names = F.sort_array(F.collect_list(F.when(F.col("_fits"), F.struct("_before", name))))
        counts.append(F.transform(names, lambda p: p[name]).alias(listed))
    packs = (
        cut.groupBy(key)
        .agg(*counts)
        .join(texts, key, "left")
        .withColumn("_parts", F.coalesce("_parts", F.array().cast(texts.schema["_parts"].dataType)))
    )
    packed = F.concat(
        F.array_join(F.transform("_parts", lambda p: p["_text"]), ""),
        F.when(F.col("is_truncated"), K.PAYLOAD_MARKER).otherwise(""),
    )
    return packs.select(
        key, once(payload=trim_space(packed)), "n_files", "is_truncated", *([listed] if listed else [])
    )


# --------------------------------------------------------------------------- requests
def may_send(policies: DataFrame) -> DataFrame:
    """Policies under which text may leave: a model is configured and sending is not forbidden.

    Only an explicit false forbids; an absent switch allows.
    """
    return policies.where(
        (F.col("base_url") != "") & F.coalesce("allow_public_cloud_transmission", F.lit(True))
    )


def review_requests(
    files: DataFrame, repos: DataFrame, policies: DataFrame, on: str = "org"
) -> DataFrame:
    """One request per repo that may send and has a payload.

    ``repos``: (repo, ``on``). The policy filter comes before any payload is built; files that the
    policy excludes are never part of one; secrets are scrubbed unless the policy says not to.
    """
    rules = exclusion_rules(repos, policies, on)
    sending = _sending(repos, policies, on)
    payloads = pack_payload(files, allowed=sending, keep=lambda rows: exclude_by_policy(rows, rules))
    return _requests(payloads, sending, "repo")


def _sending(keyed: DataFrame, policies: DataFrame, on: str) -> DataFrame:
    """``keyed`` whose policy lets text out, with what a request needs of the policy."""
    wanted = may_send(policies).select(on, "base_url", "model_name", "temperature", "timeout_ms", "data_scrubbing")
    return keyed.join(wanted, on)


def _requests(payloads: DataFrame, sending: DataFrame, key: str, *more: str) -> DataFrame:
    scrubbed = F.when(
        F.coalesce("data_scrubbing", F.lit(True)), scrub(F.col("payload"))
    ).otherwise(F.col("payload"))
    timeout = F.when(F.col("timeout_ms") > 0, F.col("timeout_ms")).otherwise(K.REVIEW_TIMEOUT_MS)
    return payloads.where(F.col("payload") != "").join(sending, key).select(
        key,
        "base_url",
        "model_name",
        "temperature",
        timeout.alias("timeout_ms"),
        F.lit(K.REVIEW_PROMPT).alias("system_prompt"),
        scrubbed.alias("payload"),
        *more,
    )


def changeset_requests(
    segments: DataFrame,
    changes: DataFrame,
    changesets: DataFrame,
    policies: DataFrame,
    on: str = "org",
    key: str = "changeset",
) -> DataFrame:
    """One request per change set (or range) that may send, with the changed functions only.

    ``segments``: (repo, path, line_start, line_end, code), as :func:`qscore.operators.changes.changed_functions` gives
    them, written; ``changes``: (key, repo, path); ``changesets``: (key, ``on``). Nothing else of a changed file is
    sent, and nothing of a file that has no changed function or that the policy excludes. ``segments`` of the result
    names what the payload holds, in order, as ``repo/path:first-last``. Exclusions apply to the
    changes, before they meet any code.
    """
    sending = _sending(changesets.select(key, on).distinct(), policies, on)
    kept = exclude_by_policy(
        changes.select(key, "repo", "path").distinct().join(sending.select(key), key, "left_semi"),
        exclusion_rules(changesets.select(key, on).distinct(), policies, on, key), key=key,
    )
    kept = materialize(kept, "kept-changes")
    place = F.concat_ws("-", "line_start", "line_end")
    name = F.concat(F.col("repo").cast("string"), F.lit("/"), "path", F.lit(":"), place)
    parts = join_few(kept, segments, ["repo", "path"], spread=(key,)).withColumn("_name", name)
    payloads = pack_payload(
        parts, key, "_name", [F.col("repo"), paths.walk_order(F.col("path")), F.col("line_start")], "code", listed="segments"
    )
    return _requests(payloads, sending, key, "segments")


def batch_review(
    requests: DataFrame,
    ask: Callable[[dict], str],
    attempts: int = K.REVIEW_ATTEMPTS,
    at_once: int = 8,
    key: str = "repo",
    pause: float = 0.0,
    journal: str | None = None,
) -> DataFrame:
    """(key, attempt, raw, ok): the answer of ``ask(request)`` to each request.

    ``request`` is the row of :func:`review_requests` as a dict, with the endpoint, the model, its
    temperature and the time limit that ``ask`` must keep. Requests run where their rows are,
    ``at_once`` of a task side by side. An exception or an answer that is no JSON object is tried again, after
    ``pause`` seconds and twice as long each time; a request that keeps failing becomes a row with ``ok`` false and
    never fails the job.

    ``journal`` is a folder that all executors reach: each usable answer is put there as it comes, under the
    hash of its request, and what lies there is never asked again, be it that a task is tried again, that the result
    is computed twice, or that a whole run starts anew. An endpoint, a model, a temperature, a prompt or a payload that
    differs is another request; requests that are alike but for ``key`` share an answer. Two tasks that ask for the same at the same moment may both be answered; the first answer stays.
    """
    kind = requests.schema[key].dataType.simpleString()
    columns = [c for c in ("base_url", "model_name", "temperature", "system_prompt", "payload") if c in requests.columns]
    names = F.sha2(F.to_json(F.struct(*columns)), 256) if journal else F.lit(None).cast("string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Journal(journal) if journal else None

        def answer(row: dict) -> tuple:
            name = row.pop("_request")
            known = book.find(name) if book else None
            if known:
                return (row[key], *known, True)
            got = _ask(ask, row, attempts, pause)
            return (row[key], *(book.keep(name, *got[:2]) if book and got[2] else got[:2]), got[2])

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                yield pd.DataFrame(
                    list(pool.map(answer, batch.to_dict("records"))), columns=[key, "attempt", "raw", "ok"]
                )

    return requests.withColumn("_request", names).mapInPandas(run, f"{key} {kind}, attempt int, raw string, ok boolean")


class Journal:
    """Answers by the hash of their request, one small file each, in 256 folders.

    A file is written aside and then moved into place, so no half answer is ever read. ``folder`` is a path or an
    address that Arrow's file systems open (``file:``, ``hdfs:``, ``s3:``).
    """

    def __init__(self, folder: str):
        address = re.sub("^file:/*", "/", folder)
        self.files, self.root = pafs.FileSystem.from_uri(address)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name[:2]}/{name}.json"

    def find(self, name: str) -> tuple[int, str] | None:
        if self.files.get_file_info(self._path(name)).type == pafs.FileType.NotFound:
            return None
        with self.files.open_input_stream(self._path(name)) as f:
            held = json.loads(f.read())
        return held["attempt"], held["raw"]

    def keep(self, name: str, attempt: int, raw: str) -> tuple[int, str]:
        """Keeps the answer unless there is one already; gives the one that stays."""
        self.files.create_dir(f"{self.root}/{name[:2]}", recursive=True)
        aside = f"{self._path(name)}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(aside) as f:
            f.write(json.dumps({"attempt": attempt, "raw": raw}).encode())
        known = self.find(name)
        if known:
            self.files.delete_file(aside)
            return known
        self.files.move(aside, self._path(name))
        return attempt, raw


def _ask(ask, request: dict, attempts: int, pause: float = 0.0) -> tuple[int, str | None, bool]:
    raw = None
    for attempt in range(1, attempts + 1):
        if attempt > 1 and pause > 0:
            time.sleep(pause * 2 ** (attempt - 2))
        try:
            raw = ask(request)
            if _usable(json.loads(raw)):
                return attempt, raw, True
        except Exception:  # a failed request is data, not a reason to fail the job
            continue
    return attempts, raw, False


def _usable(answer: object) -> bool:
    """Whether an answer has the shape of schemas.EVALUATION; absent and null parts do."""
    if answer is None:
        return True
    if not isinstance(answer, dict):
        return False
    adjust, fixes = answer.get("pillar_adjustments"), answer.get("remediations")
    points = (adjust or {}).values() if isinstance(adjust or {}, dict) else [""]
    return (
        all(p is None or (isinstance(p, (int, float)) and p is not True and p is not False) for p in points)
        and isinstance(fixes or [], list)
        and all(
            isinstance(f or {}, dict)
            and all(isinstance(v or "", str) for k, v in (f or {}).items() if k in _TEXTS[".remediations"])
            for f in fixes or []
        )
    )


# ---------------------------------------------------------------------------- answers
_TEXTS = {".remediations": ("priority", "pillar", "location", "finding", "actionable_fix")}


def parse_reviews(answers: DataFrame) -> DataFrame:
    """Adds ``ok``, the two deductions (absent: 0) and ``remediations`` (absent: empty) to ``raw``."""
    parsed = answers.select("*", once(_e=strict(F.col("raw"), schemas.EVALUATION, _TEXTS)))
    adjust = "_e.pillar_adjustments."
    empty = F.array().cast(
        "array<struct<priority:string,pillar:string,location:string,finding:string,actionable_fix:string>>"
    )
    return parsed.select(
        *answers.columns,
        F.col("_e").isNotNull().alias("ok"),
        F.coalesce(adjust + "static_health_deduction", F.lit(0.0)).alias("static_deduction"),
        F.coalesce(adjust + "architecture_deduction", F.lit(0.0)).alias("architecture_deduction"),
        F.coalesce("_e.remediations", empty).alias("remediations"),
    )


def first_success(attempts: DataFrame, key: str = "review_id") -> DataFrame:
    """The first usable answer of each review among its three attempts.

    ``attempts``: (key, attempt, raw). Reviews without one are absent: no adjustment.
    """
    good = parse_reviews(attempts).where(F.col("ok") & (F.col("attempt") <= K.REVIEW_ATTEMPTS))
    answer = F.struct("attempt", "static_deduction", "architecture_deduction", "remediations")
    return good.groupBy(key).agg(F.min_by(answer, "attempt").alias("a")).select(key, "a.*")


def deducted(pillar: Column, deduction: Column) -> Column:
    """A negative deduction counts as none; a pillar never falls below zero."""
    return F.greatest(F.lit(0.0), pillar - F.greatest(F.lit(0.0), deduction))


def enhance(scores: DataFrame, evaluations: DataFrame, key: str = "repo") -> DataFrame:
    """Scores with model deductions; without an evaluation they stay as they are.

    ``evaluations``: one row per key with the two deductions.
    """
    none = F.lit(0.0)
    joined = scores.join(
        evaluations.select(
            key, "static_deduction", "architecture_deduction", F.lit(True).alias("_reviewed")
        ),
        key,
        "left",
    )
    return joined.select(
        *[
            deducted(F.col(c), F.coalesce(f"{c}_deduction", none)).alias(c)
            if c in (K.STATIC, K.ARCHITECTURE)
            else F.col(c)
            for c in scores.columns
        ],
        F.coalesce("_reviewed", F.lit(False)).alias("llm_enhanced"),
    ).withColumn("total", total())


def review_findings(evaluations: DataFrame, key: str = "repo") -> DataFrame:
    """Remediations as findings, to be added after scoring: they never deduct or block.

    Fields that an answer leaves out are empty.
    """

    def text(name: str, of: str) -> Column:
        return F.coalesce(F.col("r")[of], F.lit("")).alias(name)

    return evaluations.select(key, F.explode("remediations").alias("r")).select(
        key,
        text("priority", "priority"),
        text("pillar", "pillar"),
        text("location", "location"),
        F.lit(0).alias("line_start"),
        F.lit(0).alias("line_end"),
        text("description", "finding"),
        text("remediation", "actionable_fix"),
        F.lit(None).cast("string").alias("severity"),
    )
