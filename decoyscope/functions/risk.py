"""Columns on certificates and registrations; the clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decoyscope.functions.terms import TRUSTED_ISSUERS
from decoyscope.functions.text import any_in, days_between


def tls_risk(host: Column, issuer: Column, subject: Column, sans: Column, not_before: Column, not_after: Column, ssl_error: Column, as_of: Column) -> Column:
    """struct of certificate flags, ages in days and a risk score; an ssl error alone scores 20."""
    age = days_between(as_of, not_before)
    own = issuer.eqNullSafe(subject)
    other = ~F.coalesce(F.array_contains(F.concat(F.array(subject), F.coalesce(sans, F.array().cast("array<string>"))), host), F.lit(False))
    trusted = any_in(issuer, TRUSTED_ISSUERS)
    very, newly = F.coalesce(age < 7, F.lit(False)), F.coalesce(age < 30, F.lit(False))
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = points(own, 30) + points(other, 25) + F.when(very, 15).when(newly, 10).otherwise(0) + points(~trusted & ~own, 10)
    return F.struct(
        own.alias("is_self_signed"),
        other.alias("has_domain_mismatch"),
        age.alias("cert_age_days"),
        very.alias("cert_is_very_new"),
        newly.alias("is_newly_issued"),
        days_between(not_after, not_before).alias("cert_validity_days"),
        trusted.alias("trusted_issuer"),
        F.when(F.coalesce(ssl_error, F.lit(False)), 20).otherwise(score).alias("cert_risk_score"),
    )


def whois_age(created: Column, expires: Column, as_of: Column) -> Column:
    age, left = days_between(as_of, created), days_between(expires, as_of)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        age.alias("domain_age_days"),
        yes(age < 30).alias("is_newly_registered"),
        yes(age < 7).alias("is_very_new"),
        left.alias("days_until_expiry"),
        yes(left < 30).alias("expires_soon"),
        F.date_format(created, "yyyy-MM-dd").alias("created"),
        F.date_format(expires, "yyyy-MM-dd").alias("expires"),
    )
