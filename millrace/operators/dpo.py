"""Preflight and evaluation of preference data: D1 to D23."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.stats import distribution
from millrace.functions.text import normal_key, py_strip, tokens_quarter, word_overlap, word_set
from millrace.functions.tokens import TEMPLATE, count


def side_text(side: Column) -> Column:
    """The first assistant content that isn't empty, else the second message's; stripped; '' for none."""
    own = F.get(F.filter(side, lambda m: (m["role"] == "assistant") & (m["content"] != "")), F.lit(0))["content"]
    return py_strip(F.coalesce(own, F.get(side, F.lit(1))["content"], F.lit("")))


def side_prompt(side: Column) -> Column:
    own = F.get(F.filter(side, lambda m: (m["role"] == "user") & (m["content"] != "")), F.lit(0))["content"]
    return F.coalesce(own, F.get(side, F.lit(0))["content"], F.lit(""))


def sides(df: DataFrame) -> DataFrame:
    """Adds chosen_text, rejected_text, missing, mismatch. Sides are message lists or plain text; null or empty ones are missing."""
    out = {}
    mismatch = F.lit(False)
    for s in ("chosen", "rejected"):
        plain = dict(df.dtypes)[s] == "string"
        out[f"{s}_text"] = F.coalesce(py_strip(F.col(s)) if plain else side_text(F.col(s)), F.lit(""))
        if not plain:
            user, prompt = side_prompt(F.col(s)), F.coalesce("prompt", F.lit(""))
            mismatch = mismatch | F.coalesce((F.size(s) > 0) & (user != "") & (prompt != "") & (py_strip(user) != py_strip(prompt)), F.lit(False))
    df = df.withColumns(out)
    blank = py_strip(F.coalesce("prompt", F.lit(""))) == ""
    return df.withColumns({"missing": blank | (F.col("chosen_text") == "") | (F.col("rejected_text") == ""), "mismatch": mismatch})


def score(df: DataFrame, side: str) -> Column:
    """A side's score by any of its three names, as a number; what is no number counts as none."""
    names = [n for n in (f"score_{side}", f"{side}_score", f"{side}_rating") if n in df.columns]
    return F.coalesce(*[F.expr(f"try_cast(`{n}` as double)") for n in names]) if names else F.lit(None).cast("double")


def judged(df: DataFrame, near: float = 0.9) -> DataFrame:
    """Adds reversed, tied, identical, similarity, near_identical to rows of sides(). Rows with a missing side have null everywhere. NaN scores are none."""
    c, r = F.nullif(score(df, "chosen"), F.lit(float("nan"))), F.nullif(score(df, "rejected"), F.lit(float("nan")))
    ok = ~F.col("missing")
    same = normal_key(F.col("chosen_text")) == normal_key(F.col("rejected_text"))
    df = df.withColumns({"_x": word_set(F.col("chosen_text")), "_y": word_set(F.col("rejected_text"))})
    df = df.withColumns({"reversed": ok & F.coalesce(c < r, F.lit(False)), "tied": ok & F.coalesce(c == r, F.lit(False)), "identical": ok & same, "similarity": F.when(ok, word_overlap(F.col("_x"), F.col("_y")))}).drop("_x", "_y")
    return df.withColumn("near_identical", ok & ~F.col("identical") & (F.col("similarity") >= near))


def token_lengths(df: DataFrame, tokens: str = "char4", template: tuple[str, str] = TEMPLATE) -> DataFrame:
    """prompt_len, chosen_len, rejected_len: by the char4 estimator, or by a tokenizer's file, which counts the templated prompt and the plain answers; any other name is refused with UnknownTokenizer."""
    names = {"prompt_len": "prompt", "chosen_len": "chosen_text", "rejected_len": "rejected_text"}
    if tokens == "char4":
        return df.withColumns({n: tokens_quarter(F.col(c)) for n, c in names.items()})
    before, after = template[0].split("{}")
    texts = {n: F.col(c) for n, c in names.items()} | {"prompt_len": F.concat(F.lit(before), F.coalesce("prompt", F.lit("")), F.lit(after))}
    return df.withColumns({n: count(c, tokens) for n, c in texts.items()})


def report(df: DataFrame, max_prompt: int = 1024, max_completion: int = 1024, max_total: int = 2048, near: float = 0.9, low: float = 0.55, high: float = 1.8, invalid_json: int = 0) -> DataFrame:
    """D2-D11 as one row over all pairs. The length ratio is one of means, 1 if either is 0. An empty table is an invalid dataset."""
    rows = token_lengths(judged(sides(df), near))
    ok = ~F.col("missing")
    p, c, r = (F.when(ok, F.col(f"{s}_len")) for s in ("prompt", "chosen", "rejected"))
    one = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("empty_pairs"), F.count_if(ok & F.col("mismatch")).alias("mismatched"), F.count_if("identical").alias("identical"), F.count_if("near_identical").alias("near_identical"),
        F.count_if("reversed").alias("reversed"), F.count_if("tied").alias("tied"), (F.count_if(ok) - F.count_distinct(F.when(ok, normal_key(F.col("prompt"))))).alias("duplicates"),
        F.count_if(p > max_prompt).alias("long_prompts"), F.count_if((c > max_completion) | (r > max_completion)).alias("long_completions"), F.count_if((p + c > max_total) | (p + r > max_total)).alias("over_total"),
        F.avg(p).alias("avg_prompt"), F.avg(c).alias("avg_chosen"), F.avg(r).alias("avg_rejected"),
    )
    ratio = F.when((F.coalesce("avg_chosen", F.lit(0.0)) == 0) | (F.coalesce("avg_rejected", F.lit(0.0)) == 0), 1.0).otherwise(F.col("avg_chosen") / F.col("avg_rejected"))
    one = one.withColumns({"length_ratio": ratio, "invalid_json": F.lit(invalid_json)})
    defects = reduce(lambda a, b: a | b, [F.col(x) > 0 for x in ("identical", "reversed", "empty_pairs", "mismatched", "invalid_json")])
    gate = F.when(F.col("total") == 0, "Invalid Dataset").when(defects, "Defects Detected").when((F.col("length_ratio") > high) | (F.col("length_ratio") < low), "Quality Warnings").otherwise("Clean Execution")
    return one.withColumn("gate", gate)


def left_truncated(ids: Column, n: int) -> Column:
    """The last n ids; shorter rows whole."""
    return F.when(F.size(ids) > n, F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n)).otherwise(ids)


def trainer_rows(df: DataFrame, eos: int, max_prompt: int, max_completion: int) -> DataFrame:
    """Prompts cut on the left, completions with an end token cut on the right. df: prompt_ids, chosen_ids, rejected_ids."""
    out = {"prompt_ids": left_truncated(F.col("prompt_ids"), max_prompt)}
    for s in ("chosen_ids", "rejected_ids"):
        out[s] = F.slice(F.concat(F.col(s), F.array(F.lit(eos))), 1, max_completion)
    return df.withColumns(out)


def collated(df: DataFrame, batch: str, pad_id: int = 0) -> DataFrame:
    """Prompts padded on the left, completions on the right, both sides to one length in a batch."""
    over = Window.partitionBy(batch)
    most_p = F.max(F.size("prompt_ids")).over(over)
    most_c = F.max(F.greatest(F.size("chosen_ids"), F.size("rejected_ids"))).over(over)
    pad = lambda n: F.array_repeat(F.lit(pad_id), n)
    return df.withColumns({"prompt_ids": F.concat(pad(most_p - F.size("prompt_ids")), F.col("prompt_ids")), "chosen_ids": F.concat(F.col("chosen_ids"), pad(most_c - F.size("chosen_ids"))), "rejected_ids": F.concat(F.col("rejected_ids"), pad(most_c - F.size("rejected_ids")))})


def stacked(df: DataFrame, key: str) -> DataFrame:
    """Chosen rows and rejected rows under each other, prompt first, with a mask that is 1 on the completion."""
    def part(side: str) -> DataFrame:
        c = F.col(f"{side}_ids")
        return df.select(key, F.lit(side).alias("side"), F.concat("prompt_ids", c).alias("ids"), F.concat(F.array_repeat(F.lit(0), F.size("prompt_ids")), F.array_repeat(F.lit(1), F.size(c))).alias("loss_mask"))

    return part("chosen").unionByName(part("rejected"))


def profile(df: DataFrame) -> DataFrame:
    """D15 in short: one wide row of format failures, score margins, lengths and bands of similarity over all rows, incomplete ones too. whole_profile() has all of D15."""
    c, r = F.nullif(score(df, "chosen"), F.lit(float("nan"))), F.nullif(score(df, "rejected"), F.lit(float("nan")))
    rows = token_lengths(judged(sides(df))).withColumns({"margin": c - r})
    cols = [
        F.count(F.lit(1)).alias("total"), F.count_if(py_strip(F.coalesce("prompt", F.lit(""))) == "").alias("blank_prompts"), F.count_if(F.col("chosen_text") == "").alias("no_chosen"), F.count_if(F.col("rejected_text") == "").alias("no_rejected"),
        F.count_if("mismatch").alias("mismatched"), F.count_if(c.isNull() | r.isNull()).alias("no_scores"), F.count_if("identical").alias("identical"), F.count_if(F.col("similarity") >= 0.9).alias("similar_90"), F.count_if(F.col("similarity") >= 0.8).alias("similar_80"),
        F.count_if((F.col("chosen_len") > 2 * F.col("rejected_len")) | (F.col("rejected_len") > 2 * F.col("chosen_len"))).alias("twice_as_long"),
    ]
    for name in ("margin", "prompt_len", "chosen_len", "rejected_len"):
        cols += [x.alias(f"{name}_{k}") for k, x in distribution(F.col(name)).items()]
    return rows.agg(*cols)


def whole_profile(df: DataFrame, max_prompt: int = 1024, max_completion: int = 1024, max_total: int = 2048) -> DataFrame:
    """One wide row of all format failures, distributions of scores, margin, similarity and lengths (whole, cut to the budgets, and chosen less rejected), budget counts, bands of similarity and length flags.

    A row counts once as missing its prompt, chosen or rejected side, in this order; only rows without such are counted further. A side is there if it has two messages, the first the user's and the second the assistant's
    (else its roles mismatch), or some text where it is plain. Scores are taken from rows with both. The bands don't overlap."""
    c, r = F.nullif(score(df, "chosen"), F.lit(float("nan"))), F.nullif(score(df, "rejected"), F.lit(float("nan")))
    has, text, roles, users = {}, {}, {}, {}
    for s in ("chosen", "rejected"):
        if dict(df.dtypes)[s] == "string":
            has[s], text[s], roles[s], users[s] = F.coalesce(F.col(s) != "", F.lit(False)), F.coalesce(F.col(s), F.lit("")), F.lit(False), F.lit(False)
            continue
        first, second = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        has[s], text[s] = F.coalesce(F.size(s) >= 2, F.lit(False)), F.coalesce(second["content"], F.lit(""))
        roles[s] = ~(first["role"].eqNullSafe("user") & second["role"].eqNullSafe("assistant"))
        users[s] = py_strip(F.coalesce(first["content"], F.lit(""))) != py_strip(F.col("prompt"))
    first_missing = F.when(F.coalesce(F.col("prompt") == "", F.lit(True)), "prompt").when(~has["chosen"], "chosen").when(~has["rejected"], "rejected")
    rows = df.select("prompt", text["chosen"].alias("chosen_text"), text["rejected"].alias("rejected_text"), first_missing.alias("gone"), c.alias("_c"), r.alias("_r"), *[x[s].alias(f"{s}_{k}") for k, x in (("roles", roles), ("users", users)) for s in ("chosen", "rejected")])
    rows = token_lengths(rows).withColumns({"_x": word_set(F.col("chosen_text")), "_y": word_set(F.col("rejected_text"))})
    ok, both = F.col("gone").isNull(), F.col("_c").isNotNull() & F.col("_r").isNotNull()
    least = {"prompt_len": max_prompt, "chosen_len": max_completion, "rejected_len": max_completion}
    rows = rows.withColumns({n: F.when(ok, F.col(n)) for n in least} | {"similarity": F.when(ok, word_overlap(F.col("_x"), F.col("_y"))), "same": ok & (normal_key(F.col("chosen_text")) == normal_key(F.col("rejected_text")))})
    rows = rows.withColumns({f"{n}_cut": F.when(ok, F.least(n, F.lit(most))) for n, most in least.items()} | {"score_chosen": F.when(ok & both, F.col("_c")), "score_rejected": F.when(ok & both, F.col("_r"))})
    rows = rows.withColumns({"margin": F.col("score_chosen") - F.col("score_rejected"), "delta_len": F.col("chosen_len") - F.col("rejected_len"), "delta_len_cut": F.col("chosen_len_cut") - F.col("rejected_len_cut")})
    p, x, y, sim, m = (F.col(n) for n in ("prompt_len", "chosen_len", "rejected_len", "similarity", "margin"))
    failures = {f"missing_{s}": F.col("gone") == s for s in ("prompt", "chosen", "rejected")} | {"missing_scores": ok & ~both}
    failures |= {f"{s}_role_mismatch": ok & F.col(f"{s}_roles") for s in ("chosen", "rejected")} | {f"{s}_prompt_mismatch": ok & F.col(f"{s}_users") for s in ("chosen", "rejected")}
    over = {"prompt_over": p > max_prompt, "chosen_over": x > max_completion, "rejected_over": y > max_completion, "chosen_total_over": p + x > max_total, "rejected_total_over": p + y > max_total}
    flags = failures | {"reversed": m < 0, "tied": m == 0, "positive": m > 0} | over | {"any_over": reduce(lambda a, b: a | b, over.values())}
    flags |= {"identical": F.col("same"), "near_identical_90": ~F.col("same") & (sim >= 0.9), "elevated_80": ~F.col("same") & (sim >= 0.8) & (sim < 0.9), "chosen_twice": x > 2 * y, "rejected_twice": y > 2 * x}
    cols = [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("complete"), *[F.count_if(f).alias(k) for k, f in flags.items()]]
    cols += [F.try_divide(F.avg(a), F.avg(b)).alias(k) for k, a, b in (("length_ratio", "chosen_len", "rejected_len"), ("length_ratio_cut", "chosen_len_cut", "rejected_len_cut"))]
    for name in ("score_chosen", "score_rejected", "margin", "similarity", *least, "delta_len", *[f"{n}_cut" for n in least], "delta_len_cut"):
        cols += [v.alias(f"{name}_{k}") for k, v in distribution(F.col(name)).items()]
    one = rows.agg(*cols)
    return one.withColumn("clean_pct", F.try_divide(F.lit(100.0) * (F.col("total") - reduce(lambda a, b: a + b, [F.col(k) for k in failures])), F.col("total")))


def implicit_rewards(df: DataFrame, beta: float = 0.1) -> DataFrame:
    """Adds reward_chosen, reward_rejected, margin, loss from policy and reference log-probabilities (pi_*, ref_*)."""
    df = df.withColumns({"reward_chosen": beta * (F.col("pi_chosen") - F.col("ref_chosen")), "reward_rejected": beta * (F.col("pi_rejected") - F.col("ref_rejected"))})
    df = df.withColumn("margin", F.col("reward_chosen") - F.col("reward_rejected"))
    return df.withColumn("loss", F.greatest(-F.col("margin"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("margin"))))


def population(df: DataFrame) -> DataFrame:
    """One row: positive, zero, negative margins, accuracy (ties lose), mean, lower median, sample deviation, mean loss, raw likelihood wins."""
    m = F.col("margin")
    return df.agg(
        F.count_if(m > 0).alias("positive"), F.count_if(m == 0).alias("zero"), F.count_if(m < 0).alias("negative"), F.try_divide(F.count_if(m > 0), F.count(m)).alias("accuracy"), F.avg(m).alias("mean"),
        F.expr("percentile_disc(0.5) within group (order by margin)").alias("lower_median"), F.stddev_samp(m).alias("std"), F.avg("loss").alias("loss"), F.count_if(F.col("ref_chosen") > F.col("ref_rejected")).alias("likelihood_wins"),
    )


def batch_mean_accuracy(df: DataFrame, ordinal: str, batch_size: int = 2) -> DataFrame:
    """The mean over batches of each batch's accuracy; differs from the population's where the last batch is short."""
    b = df.groupBy(F.floor(F.col(ordinal) / batch_size).alias("b")).agg(F.avg(F.when(F.col("margin") > 0, 1.0).otherwise(0.0)).alias("a"))
    return b.agg(F.count(F.lit(1)).alias("batches"), F.avg("a").alias("batch_accuracy"))


def evaluator_differences(a: DataFrame, b: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """One row: pairs, for each measure the mean and the largest absolute difference, and how often the margin's sign differs."""
    both = a.select(key, *[F.col(m).alias(f"a_{m}") for m in measures]).join(b.select(key, *[F.col(m).alias(f"b_{m}") for m in measures]), key)
    cols = [F.count(F.lit(1)).alias("pairs")]
    for m in measures:
        d = F.abs(F.col(f"a_{m}") - F.col(f"b_{m}"))
        cols += [F.avg(d).alias(f"{m}_mean"), F.max(d).alias(f"{m}_max")]
    if "margin" in measures:
        cols.append(F.count_if(F.signum("a_margin") != F.signum("b_margin")).alias("sign_flips"))
    return both.agg(*cols)


def loader_audit(df: DataFrame, eos: int, max_total: int) -> DataFrame:
    """One row: token mismatches, missing end tokens and rows over budget. df: ids, approved_ids."""
    return df.agg(F.count_if(F.col("ids") != F.col("approved_ids")).alias("token_mismatch"), F.count_if(F.coalesce(F.try_element_at("ids", F.lit(-1)), F.lit(-1)) != eos).alias("no_end"), F.count_if(F.size("ids") > max_total).alias("over_budget"), F.count(F.lit(1)).alias("rows"))


def transitions(a: DataFrame, b: DataFrame, key: str, won: str = "won") -> DataFrame:
    """a_won, b_won, n: how rows moved between two runs."""
    return a.select(key, F.col(won).alias("a_won")).join(b.select(key, F.col(won).alias("b_won")), key).groupBy("a_won", "b_won").agg(F.count(F.lit(1)).alias("n"))
