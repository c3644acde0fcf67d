"""X-18: several jobs on one frame in a single pass."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import predicates as P
from cloakframe.functions.digests import keyed_random
from cloakframe.functions.text import first_error, to_base64url
from cloakframe.operators.commitments import commit_plain_error, commitment_column
from cloakframe.operators.encryption import record_errors, record_label, record_nonce, sealed_record
from cloakframe.operators.fpe import fpe_column, fpe_error
from cloakframe.operators.masking import mask_column, mask_error
from cloakframe.operators.sharing import exploded_shares, secret_errors, with_share_bytes
from cloakframe.operators.tags import tag_column
from cloakframe.operators.tokens import new_token, token_plain_errors, with_vault_data
from cloakframe.plans.jobs import JobError, finish, lifecycle_error, require_unique_refs
from cloakframe.plans.policy import Policy
from cloakframe.plans.runtime import new_scratch, remove_folder


@dataclass(frozen=True)
class Step:
    """One output column: ``job`` is mask, fpe, digest or commit.

    ``protect_and_store`` also takes encrypt (its profile is the id of the key), tokenize and split.
    """

    job: str
    source: str
    profile: str
    output: str
    ref: str | None = None


def _columns(steps: list[Step], policy: Policy) -> tuple[list, dict, dict]:
    """What may be wrong, the output columns, and helper columns they read."""
    problems, outputs, openings = [], {}, {}
    ok = F.col("error").isNull()
    for s in steps:
        value = F.col(s.source)
        if s.job == "mask":
            p = policy.column("mask", s.profile)
            problems.append(mask_error(value, p))
            outputs[s.output] = mask_column(value, p)
        elif s.job == "fpe":
            spec, p = policy.profile("fpe", s.profile), policy.column("fpe", s.profile)
            problems.append(fpe_error(value, spec, p, "plaintext", "new"))
            outputs[s.output] = fpe_column(value, spec, p, ok, True)
        elif s.job == "digest":
            spec, p = policy.profile("mac", s.profile), policy.column("mac", s.profile)
            problems += [
                lifecycle_error(p["key_status"], "new"),
                P.text_error("plaintext", value),
            ]
            outputs[s.output] = tag_column(value, p, spec["algorithm"])
        elif s.job == "commit":
            spec, p = policy.profile("commit", s.profile), policy.column("commit", s.profile)
            problems.append(commit_plain_error(s.source, p, "new"))
            name = f"{s.output}_opening"
            problems.append(P.ref_error(F.col(s.ref).cast("string")))
            raw = keyed_random(
                policy.random_column(),
                f"opening|{s.profile}|{s.source}",
                spec["opening_len"],
                s.ref,
                s.source,
            )
            openings[f"_{name}"] = to_base64url(raw)
            outputs[name] = F.col(f"_{name}")
            outputs[s.output] = commitment_column(value, F.col(f"_{name}"), p, spec["algorithm"])
        else:
            raise ValueError(f"unknown job: {s.job}")
    return problems, outputs, openings


def protect_frame(
    df: DataFrame,
    steps: list[Step],
    policy: Policy,
    drop: list[str] = (),
    on_error: str = "quarantine",
    pos: str | None = None,
):
    """Compute every step from the original columns: one scan, no shuffle.

    All Python work (FPE and non-SHA-2 tags) lands in one Arrow stage. ``drop`` names the
    plaintext columns to remove at the end.
    """
    problems, outputs, openings = _columns(steps, policy)
    for ref in {s.ref for s in steps if s.job == "commit"}:
        require_unique_refs(df, ref)
    made = df.withColumns(openings) if openings else df
    drop = [*drop, *openings]
    done = finish(made, outputs, first_error(*problems), on_error, pos)
    if isinstance(done, tuple):
        return tuple(f.drop(*drop) for f in done)
    return done.drop(*drop)


@dataclass(frozen=True)
class Protected:
    """What ``protect_and_store`` has made; all frames read one stored stage."""

    rows: DataFrame
    rejects: DataFrame
    vault: DataFrame | None
    shares: dict[str, DataFrame]
    path: str

    def erase(self) -> None:
        """Remove the stage, once its frames have been written where they belong."""
        remove_folder(self.rows.sparkSession, self.path)


def protect_and_store(df: DataFrame, steps: list[Step], policy: Policy, drop: list[str]) -> Protected:
    """All seven jobs on one frame: one scan, one stored stage, then rows, vault rows and shares.

    The stage holds one wide row per input row with what the jobs have made and none of the columns
    in ``drop``, so no plaintext. ``rows`` has an output column for each step (the token of a
    tokenized value, the ``set_id`` of a split one), ``vault`` the rows to append to the vault, and
    ``shares`` for each split step ``set_id, index, share``. Refs are unique over the frame, which
    is looked up in the stage; a ref used twice removes it and refuses the frame.
    """
    basic = [s for s in steps if s.job not in ("encrypt", "tokenize", "split")]
    problems, outputs, helpers = _columns(basic, policy)
    made = df.withColumns(helpers) if helpers else df
    hidden, tokens, splits = [*helpers], {}, {}
    ts = F.lit(str(int(time.time())))
    for i, s in enumerate(steps):
        if s.job == "encrypt":
            nonce, label = f"_nonce{i}", record_label(s.profile, policy, ts)
            made = made.withColumn(nonce, record_nonce(s.source, s.profile, policy, s.ref, label))
            outputs[s.output] = sealed_record(s.source, s.profile, policy, F.col(nonce), label, ts)
            problems += record_errors(s.source, s.profile, policy)
            hidden.append(nonce)
        elif s.job == "tokenize":
            names = [f"_token{i}", f"_hashid{i}", f"_data{i}"]
            token = F.when(F.col(s.source).isNotNull(), new_token(s.source, s.profile, policy, s.ref))
            made = with_vault_data(made.withColumn(names[0], token), names[0], s.source, s.profile, policy, s.ref)
            made = made.withColumnsRenamed({"hashid": names[1], "data": names[2]})
            outputs |= {s.output: F.col(names[0]), **{n: F.col(n) for n in names[1:]}}
            problems += token_plain_errors(s.source, s.profile, policy, s.ref)
            hidden.append(names[0])
            tokens[s.output] = s, names[1:]
        elif s.job == "split":
            names = [f"_set{i}", f"_shares{i}"]
            made = with_share_bytes(made, s.source, s.profile, policy, s.ref, F.lit(True))
            made = made.withColumnsRenamed({"set_id": names[0], "share_bytes": names[1]})
            outputs |= {s.output: F.col(names[0]), names[1]: F.col(names[1])}
            problems += secret_errors(s.source, s.profile, policy, s.ref)
            hidden.append(names[0])
            splits[s.output] = s, names[1]
    spark, path = df.sparkSession, new_scratch(df.sparkSession, "protected")
    wide = finish(made, outputs, first_error(*problems), "null", None).drop(*hidden, *drop)
    wide.write.parquet(path)
    stage = spark.read.schema(wide.schema).parquet(path)
    for ref in {s.ref for s in steps if s.ref}:
        try:
            require_unique_refs(stage, ref)
        except JobError:
            remove_folder(spark, path)
            raise
    extra = [c for _, names in tokens.values() for c in names] + [c for _, c in splits.values()]
    good = stage.where("error is null").drop("error")
    vault, shares = None, {}
    for s, (hashid, data) in tokens.values():
        rows = good.where(F.col(data).isNotNull()).select(
            F.lit(policy.profile("token", s.profile)["kid"]).alias("kid"), F.col(hashid).alias("hashid"), F.col(data).alias("data")
        )
        vault = rows if vault is None else vault.union(rows)
    for name, (s, values) in splits.items():
        held = good.where(F.col(values).isNotNull()).select(F.col(name).alias("set_id"), F.col(values).alias("bytes"))
        shares[name] = exploded_shares(held, "set_id", "bytes", s.profile, policy)
    rejects = stage.where("error is not null").select(*[c for c in df.columns if c not in drop], "error")
    return Protected(good.drop(*extra), rejects, vault, shares, path)
