"""Profile and trust policy: findings as rows, each check a join or an aggregate over the folded tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fold import KEY
from ..functions.text import namespace
from ..schema import FoldedGraph

#: Vocabularies that belong to a profile, the streaming vocabulary, and the sealed-source predicate.
VOCABULARIES = {"files": "https://w3id.org/gts/files#"}
STREAM = "https://w3id.org/gts/stream#"
SEALED = STREAM + "sealedSource"


@dataclass(frozen=True)
class Policy:
    """Trusted key ids (none: trust isn't evaluated), and the pattern of pseudonymous recipients."""

    trusted: tuple[str, ...] = ()
    require_trusted: bool = False
    pseudonymous: str = r"^anon:[0-9a-fA-F]{32,}$"

    @classmethod
    def from_text(cls, text: str) -> Policy:
        """From JSON or YAML: trusted_signers, require_trusted_signer, pseudonymous_kid_pattern; other keys are an error."""
        try:
            data = json.loads(text)
        except ValueError:
            import yaml

            data = yaml.safe_load(text)
        names = {"trusted_signers": "trusted", "require_trusted_signer": "require_trusted", "pseudonymous_kid_pattern": "pseudonymous"}
        if not isinstance(data, dict) or set(data) - set(names):
            raise ValueError("a trust policy has trusted_signers, require_trusted_signer and pseudonymous_kid_pattern")
        given = {names[k]: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
        return cls(**given)


def trust(g: FoldedGraph, policy: Policy) -> DataFrame:
    """Signatures with whether they are valid and by a trusted key."""
    return g.signatures.withColumn("trusted", (F.col("status") == "valid") & F.coalesce(F.col("kid").isin(*policy.trusted), F.lit(False)) if policy.trusted else F.lit(False))


def signature_counts(g: FoldedGraph, policy: Policy) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return trust(g, policy).groupBy("path").agg(F.count("*").alias("signed"), one("valid"), F.count_if("trusted").alias("trusted"), one("invalid"), one("unverified"))


def findings(g: FoldedGraph, policy: Policy | None = None, vocabularies: dict[str, str] | None = None) -> DataFrame:
    """path, seg, profile, code, severity."""
    policy, vocabularies = policy or Policy(), vocabularies or VOCABULARIES
    segs = g.segments.select(*KEY, "profile", "claimed", "head")
    out: list[DataFrame] = []

    def add(df: DataFrame, code: str, severity: str, profile=None) -> None:
        out.append(df.select(*KEY, (F.col("profile") if profile is None else profile).alias("profile"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    used_ids = g.quads.select(*KEY, F.explode(F.array("s", "p", "o", "g")).alias("tid")).filter("tid is not null").distinct()
    iris = g.terms.filter("kind = 0").join(used_ids, [*KEY, "tid"], "left_semi").select(*KEY, "lex")
    spaces = iris.select(*KEY, namespace(F.col("lex")).alias("space")).distinct()
    known = segs.sparkSession.createDataFrame(list(vocabularies.items()), "owner string, space string")
    used = spaces.join(F.broadcast(known), "space").select(*KEY, "owner")
    add(used.join(segs, list(KEY)).filter("owner != profile"), "ProfileVocabularyUndeclared", "error", F.col("owner"))
    add(segs.filter(F.col("profile").isin(*vocabularies)).join(used.withColumnRenamed("owner", "profile"), [*KEY, "profile"], "left_anti"), "ProfileVocabularyUnused", "warning")
    streams = iris.filter(F.col("lex").startswith(STREAM)).select(*KEY).distinct()
    add(segs.filter("not claimed").join(streams, list(KEY), "left_semi"), "StreamVocabularyWithoutLayout", "warning", F.lit("stream"))

    sealed = g.quads.join(g.terms.filter(F.col("lex") == SEALED).select(*KEY, F.col("tid").alias("p")), [*KEY, "p"], "left_semi").select(*KEY).distinct()
    strict = segs.filter("profile in ('evidence', 'opaque')")
    per = g.signatures.groupBy(*KEY).agg(
        F.count_if(F.col("status") == "invalid").alias("invalid"), F.count_if(F.col("status") == "unverified").alias("unverified"), F.count_if(F.col("status") == "valid").alias("valid"),
        F.count_if((F.col("status") == "valid") & (F.col("kid").isin(*policy.trusted) if policy.trusted else F.lit(False))).alias("trusted"),
    )
    unsigned = strict.join(per, list(KEY), "left_anti")
    add(unsigned.filter("profile = 'opaque'").unionByName(unsigned.filter("profile = 'evidence'").join(sealed, list(KEY), "left_anti")), "ProfileSignatureRequired", "error")
    signed = strict.join(per, list(KEY))
    add(signed.filter("invalid > 0"), "ProfileSignatureInvalid", "error")
    add(signed.filter("unverified > 0"), "ProfileSignatureUnverified", "error")
    if policy.require_trusted:
        add(signed.filter("trusted = 0"), "ProfileSignerUntrusted", "error")
    elif not policy.trusted:
        add(signed.filter("valid > 0"), "ProfileSignerTrustNotEvaluated", "warning")
    committed = g.signatures.filter("status in ('valid', 'unverified')").select(*KEY, F.col("frame_id").alias("head"))
    add(segs.filter("profile = 'evidence'").join(sealed, list(KEY), "left_anti").join(committed, [*KEY, "head"], "left_anti"), "EvidenceHeadCommitmentRequired", "error")
    # recipients of frames that stayed sealed, in opaque packages
    closed = g.opaque.select(*KEY, "item").distinct()
    sealed_to = g.recipients.join(closed, [*KEY, "item"], "left_semi").join(segs.filter("profile = 'opaque'").select(*KEY), list(KEY), "left_semi")
    out.append(recipient_findings(sealed_to, policy).select(*KEY, F.lit("opaque").alias("profile"), "code", F.lit("error").alias("severity")))
    return reduce(DataFrame.unionByName, out)


def recipient_findings(recipients: DataFrame, policy: Policy | None = None) -> DataFrame:
    """path, seg, code for the recipients (path, seg, kid) of an opaque package: kid missing, or not pseudonymous."""
    policy = policy or Policy()
    code = F.when(F.col("kid").isNull(), "OpaqueRecipientKidMissing").when(~F.col("kid").rlike(policy.pseudonymous), "OpaqueRecipientKidPublic")
    return recipients.select(*KEY, code.alias("code")).filter("code is not null")
