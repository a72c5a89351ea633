"""Validation of records, confidence and review priority. Zero and empty count as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import vocab as V
from tallyglass.functions.columns import any_in, bound, matches, pattern


def present(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)) != 0


def said(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


@bound
def valid_weight(value: Column, unit_near: Column) -> Column:
    """In range and no year: one from 2000 to 2099 needs a unit near by, one to 2029 is always a year."""
    year = value.between(2000, 2099) & (~unit_near | (value <= 2029))
    return F.coalesce(value.between(*V.CANDIDATE_RANGE) & ~year, F.lit(False))


@bound
def valid_triplet(total: Column, tare: Column, net: Column, ratio: tuple[float, float] = V.RATIO) -> Column:
    """Whether the three weights can belong together."""
    ok = (total > 0) & (tare >= V.RANGES["tare_weight"][0]) & (net >= V.RANGES["net_weight"][0]) & (tare < total) & (net < total)
    return F.coalesce(F.when(ok, (net / total).between(*ratio)), F.lit(False))


@bound
def sane_triplet(total: Column, tare: Column, net: Column) -> Column:
    return present(total) & present(tare) & present(net) & (F.abs(total - (tare + net)) <= V.SANITY_TOLERANCE)


def balanced(total: Column, tare: Column, net: Column) -> Column:
    return F.abs(total - (tare + net)) <= V.EQUATION_TOLERANCE


@bound
def assigned(a: Column, b: Column, c: Column, ratio: tuple[float, float] = V.RATIO) -> Column:
    """The first order of three values that makes a valid total, tare and net, as a struct; null if none does."""
    orders = [(a, b, c), (a, c, b), (b, a, c), (b, c, a), (c, a, b), (c, b, a)]
    return F.coalesce(*[F.when(balanced(*o) & valid_triplet(*o, ratio), triplet(*o)) for o in orders])


def triplet(total: Column, tare: Column, net: Column) -> Column:
    return F.struct(total.cast("int").alias("total_weight"), tare.cast("int").alias("tare_weight"), net.cast("int").alias("net_weight"))


def _some(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def triplet_issues(total: Column, tare: Column, net: Column) -> Column:
    """What is wrong with the weights, in order."""
    out = []
    for name, value, title in (("total_weight", total, "총중량"), ("tare_weight", tare, "공차중량"), ("net_weight", net, "실중량")):
        out.append(F.when(present(value) & ~value.between(*V.RANGES[name]), F.format_string(f"{title} 범위 초과: %dkg", value)))
    error = F.abs(net - (total - tare))
    out.append(F.when(unbalanced(total, tare, net), F.format_string("방정식 불만족: %d ≠ %d + %d (오차: %dkg)", total, tare, net, error)))
    share = F.when(present(total) & present(net), net / F.nullif(total, F.lit(0)))
    percent = F.concat(F.format_string("%.2f", F.bround(share * 100, 2)), F.lit("%"))
    out.append(F.when(~share.between(*V.RATIO), F.concat(F.lit("비율 이상: Net/Total = "), percent)))
    out.append(F.when(present(total) & present(tare) & (tare >= total), F.lit("논리 오류: 공차중량 ≥ 총중량")))
    out.append(F.when(present(total) & present(net) & (net >= total), F.lit("논리 오류: 실중량 ≥ 총중량")))
    return _some(*out)


def unbalanced(total: Column, tare: Column, net: Column) -> Column:
    """All three weights are there and the equation fails: the net weight is then repaired."""
    return F.coalesce(present(total) & present(tare) & present(net) & (F.abs(net - (total - tare)) > V.EQUATION_TOLERANCE), F.lit(False))


def weight_confidence(field: str, value: Column) -> Column:
    out = F.lit(100.0) - F.when(~value.between(*V.RANGES[field]), 30.0).otherwise(0.0) - F.when(value % 1000 == 0, 5.0).otherwise(0.0)
    return F.when(value.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), out))


DATE = r"^(\d{4})-(\d{1,2})-(\d{1,2})"


def date_head(date: Column) -> Column:
    """The ISO date that a text begins with; empty if there is none."""
    return F.regexp_extract(date, pattern(DATE), 0)


def head_day(head: Column) -> Column:
    return F.try_to_date(head, "yyyy-M-d")


def date_checked(date: Column, head: Column, day: Column, as_of: Column) -> Column:
    """struct(confidence, issues) of an ISO date, judged as of a given day; head and day are date_head() and head_day() of it. A date that doesn't exist is a parse error."""
    year = F.substring(head, 1, 4).try_cast("int")
    off = ~year.between(*V.YEARS)
    late = day > as_of
    good = F.greatest(F.lit(0.0), F.lit(100.0) - F.when(off, 30.0).otherwise(0.0) - F.when(late, 20.0).otherwise(0.0))
    issues = _some(F.when(off, F.format_string("연도 범위 초과: %d", year)), F.when(late, F.lit("미래 날짜")))
    return (
        F.when(~said(date), _checked(0.0, "날짜 없음")).when(head == "", _checked(50.0, "비표준 형식")).when(day.isNull(), _checked(30.0, "파싱 오류"))
        .otherwise(F.struct(good.alias("confidence"), issues.alias("issues")))
    )


def _checked(confidence: float, *issues: str) -> Column:
    return F.struct(F.lit(confidence).alias("confidence"), (F.array(*map(F.lit, issues)) if issues else F.array().cast("array<string>")).alias("issues"))


def vehicle_checked(plate: Column) -> Column:
    short = "4자리 숫자만 (지역/문자 누락 가능성)"
    return (
        F.when(~said(plate), _checked(0.0, "차량번호 없음")).when(matches(plate, V.PLATE_STANDARD), _checked(100.0))
        .when(matches(plate, r"^\d{4}$") & F.startswith(plate, F.lit("202")), _checked(50.0, short, "연도로 오인 가능")).when(matches(plate, r"^\d{4}$"), _checked(80.0, short))
        .otherwise(_checked(60.0, "비표준 형식"))
    )


def excluded(name: Column) -> Column:
    """The first word that no company's name holds, or null."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in V.COMPANY_EXCLUDED])


def company_checked(name: Column, worst: Column) -> Column:
    """struct(confidence, issues) of a name; worst is excluded() of it."""
    short, foreign, wordless = F.char_length(name) < 2, ~matches(name, "[가-힣]"), ~matches(name, "[가-힣a-zA-Z]")
    lost = sum((F.when(c, n).otherwise(0.0) for c, n in ((short, 40.0), (worst.isNotNull(), 30.0), (foreign, 20.0), (wordless, 50.0))), F.lit(0.0))
    issues = _some(F.when(short, F.lit("너무 짧음")), F.when(worst.isNotNull(), F.concat(F.lit("잘못된 추출: '"), worst, F.lit("' 포함"))), F.when(foreign, F.lit("한글 없음")), F.when(wordless, F.lit("문자 없음")))
    return F.when(~said(name), _checked(0.0, "회사명 없음")).otherwise(F.struct(F.greatest(F.lit(0.0), F.lit(100.0) - lost).alias("confidence"), issues.alias("issues")))


def overall(confidences: dict[str, Column]) -> Column:
    """The weighted mean of the confidences that are there, 0 if none is."""
    up = sum((F.coalesce(c * V.FIELD_WEIGHTS.get(k, 1.0), F.lit(0.0)) for k, c in confidences.items()), F.lit(0.0))
    down = sum((F.when(c.isNotNull(), V.FIELD_WEIGHTS.get(k, 1.0)).otherwise(0.0) for k, c in confidences.items()), F.lit(0.0))
    return F.when(down > 0, up / down).otherwise(0.0)


def priority(confidence: Column, issues: Column) -> Column:
    """HIGH for a severe issue, else by the confidence, not yet rounded."""
    out = F.when(F.exists(issues, lambda x: any_in(x, V.SEVERE_ISSUES)), "HIGH")
    for name, least in V.PRIORITIES[:-1]:
        out = out.when(confidence >= least, name)
    return out.otherwise("CRITICAL")


def needs_review(priority_: Column) -> Column:
    return priority_.isin("MEDIUM", "HIGH", "CRITICAL")


def scored(df: DataFrame, as_of: Column) -> DataFrame:
    """df, with a column for each field, and the columns of scoring; net_weight is repaired after it was scored.

    What is used more than once is a column of its own first, so each step is compiled code over the columns before it: nothing but the titles of issues and the search for severe ones
    goes by array functions, which Spark interprets."""
    c, weights = F.col, [F.col(k) for k in V.RANGES]
    df = df.withColumns({"_q_head": date_head(c("date")), "_q_worst": excluded(c("company"))})
    df = df.withColumn("_q_on", head_day(c("_q_head")))
    df = df.withColumns({"_q_day": date_checked(c("date"), c("_q_head"), c("_q_on"), as_of), "_q_plate": vehicle_checked(c("vehicle_num")), "_q_name": company_checked(c("company"), c("_q_worst"))})
    df = df.withColumns({"_q_unlike": triplet_issues(*weights), "repaired": unbalanced(*weights)} | {f"_q_{k}": F.when(present(c(k)), weight_confidence(k, c(k))) for k in V.RANGES})
    each = {"date": c("_q_day.confidence"), "vehicle_num": c("_q_plate.confidence")} | {k: c(f"_q_{k}") for k in V.RANGES} | {"company": c("_q_name.confidence")}
    issues = F.concat("_q_unlike", _titled(c("_q_day.issues"), "날짜: "), _titled(c("_q_plate.issues"), "차량번호: "), _titled(c("_q_name.issues"), "회사명: "))
    df = df.withColumns({"_q_mean": overall(each), "issues": issues})
    df = df.withColumn("review_priority", priority(c("_q_mean"), c("issues")))
    confidences = F.map_filter(F.create_map(*[x for k, v in each.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    total, tare, net = weights
    df = df.withColumns({
        "field_confidences": confidences, "overall_confidence": F.bround("_q_mean", 2), "needs_review": needs_review(c("review_priority")), "net_weight": F.when(c("repaired"), total - tare).otherwise(net),
    })
    return df.drop("_q_head", "_q_worst", "_q_on", "_q_day", "_q_plate", "_q_name", "_q_unlike", "_q_mean", *[f"_q_{k}" for k in V.RANGES])


def _titled(issues: Column, title: str) -> Column:
    return F.transform(issues, lambda i: F.concat(F.lit(title), i))
