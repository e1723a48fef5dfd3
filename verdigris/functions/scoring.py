"""Decision tables over columns: scores, routes, classes and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def first_match(cases: list[tuple[Column, Column | str | float | int | bool]], default) -> Column:
    """The value of the first condition that holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for test, value in reversed(cases):
        out = F.when(test, value).otherwise(out)
    return out


def codes(tests: list[tuple[Column, str]]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(t, F.lit(name)) for t, name in tests)))


def save_intent(verb: Column, object_: Column, weak: Column, context: Column) -> Column:
    return first_match([(verb & object_, "strong"), (verb, "item"), (weak & context, "weak_with_context"), (weak, "weak")], "none")


def knowledge_source(retrieved: Column, model: Column) -> Column:
    return first_match([(retrieved & model, "mixed"), (retrieved, "retrieved"), (model, "model")], "none")


def volatility(high: Column, low: Column) -> Column:
    """0.10 low only, 0.25 both, 0.85 high only, 0.45 neither."""
    return first_match([(low & ~high, 0.10), (low & high, 0.25), (high, 0.85)], 0.45)


def recency_penalty(matches: Column, exempt: Column) -> Column:
    return F.when(exempt | (matches == 0), 0.0).otherwise(F.least(F.lit(0.30), matches * 0.10))


def failure_penalty(failures: Column) -> Column:
    return F.least(F.lit(0.20), F.coalesce(failures, F.lit(0)) * 0.05)


def model_class(name: Column, known: tuple[tuple[str, str], ...] = (("mini", "small"), ("large", "large"))) -> Column:
    """By substring in order, else by the parameter count in billions, else micro."""
    size = F.regexp_extract(F.lower(name), r"([0-9]+)b", 1).try_cast("int")
    return first_match([*((F.contains(F.lower(name), F.lit(k)), v) for k, v in known), (size <= 7, "micro"), (size <= 13, "small"), (size <= 34, "medium"), (size > 34, "large")], "micro")


#: Prior reliability by model class.
PRIORS = (("micro", 0.50), ("small", 0.63), ("medium", 0.76), ("large", 0.85))


def prior(kind: Column) -> Column:
    return first_match([(kind == k, v) for k, v in PRIORS], 0.50)


def reliability(prior_: Column, adjustment: Column, recency: Column, history: Column) -> Column:
    return clip(prior_ + adjustment - recency - history)


def eligible(tvs: Column, mkr: Column) -> Column:
    return (tvs < 0.30) & (mkr >= 0.52)


def fail_codes(tvs: Column, mkr: Column, recency: Column, history: Column) -> Column:
    return codes([(tvs >= 0.30, "TVS"), (mkr < 0.52, "MKR_PRIOR"), (recency > 0, "FRESH"), (history > 0, "HIST")])


def convergence_gain(early: Column, keywords: Column, tvs: Column, evidence: Column, sources: Column) -> tuple[Column, Column, Column]:
    """(gain, damping, dangerous)."""
    gain = F.when(early, 0.1).otherwise(clip(keywords + (tvs - 0.6) / 2 + evidence))
    return gain, 0.4 + F.least(F.lit(0.2), sources * 0.05), gain > 0.5


def entropy(logprobs: Column) -> Column:
    """Normalised entropy of top-k log-probabilities; one alone counts as -lp / 10, clipped."""
    weights = F.transform(logprobs, lambda x: F.exp(x - F.array_max(logprobs)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    h = F.aggregate(weights, F.lit(0.0), lambda a, x: a - x / total * F.log(x / total))
    return F.when(F.size(logprobs) > 1, clip(h / F.log(F.size(logprobs).cast("double")))).otherwise(clip(-F.get(logprobs, 0) / 10))


def diversity(distinct: Column, total: Column) -> Column:
    return F.when(total < 2, 0.0).otherwise(F.least(F.lit(1.0), 1.5 * distinct / total))


def appraisal(triggers: Column) -> tuple[Column, Column, Column]:
    """(completeness, clarity, uncertainty) from whether any trigger of under-specification holds."""
    return F.when(triggers, 0.35).otherwise(0.80), F.when(triggers, 0.40).otherwise(0.85), F.when(triggers, 0.75).otherwise(0.30)


def route(safety: Column, correction: Column, self_ref: Column, completeness: Column, clarity: Column, stable: Column, eligible_: Column, fresh: Column, uncertainty: Column, definitional: Column, volatile_fail: Column) -> tuple[Column, Column]:
    """(route, reason): the rules in order, the first that holds."""
    rules = [
        (safety, "abstain", "SAFETY"), (correction, "verify", "USER_CORRECTION"), (self_ref, "answer", "SELF_REFERENTIAL"), ((completeness < 0.6) | (clarity < 0.6), "ask", "MISSING_CONSTRAINTS"),
        (stable & eligible_, "answer", "LOW_STAKES_STABLE"), (stable, "verify", "STABLE_BLOCKED"), (fresh | (uncertainty >= 0.7), "verify", "FRESHNESS_SENSITIVE"),
        (definitional & eligible_, "answer", "DEFINITIONAL_PASS"), (definitional & volatile_fail, "verify", "DEFINITIONAL_NEEDS_EVIDENCE"), (definitional, "answer", "DEFINITIONAL"),
    ]
    return first_match([(t, r) for t, r, _ in rules], "answer"), first_match([(t, c) for t, _, c in rules], "DEFAULT")


def quality_bucket(score: Column, low: float, high: float) -> Column:
    return first_match([(score < low, "low"), (score >= high, "high")], "medium")


def sampling_rate(age: Column) -> Column:
    """By the turn's number in its session."""
    return first_match([(age <= 3, 0.30), (age <= 20, 0.10)], 0.05)


def hash_draw(seed: str, key: Column) -> Column:
    """A reproducible number in [0, 1) from a hash, in place of a random draw."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def salience(kind: Column, turns: Column, corrected: Column, tvs: Column) -> Column:
    """0.40 base, more for corrections, kind and length, less for volatile matters."""
    return clip(0.40 + F.when(corrected, 0.20).otherwise(0.0) + F.when(kind == "preference", 0.15).otherwise(0.0) + F.least(F.lit(0.10), turns * 0.02) - F.when(tvs > 0.7, 0.15).otherwise(0.0))


def time_to_live(kind: Column, tvs: Column, days: int = 7) -> Column:
    """Days: null for kinds that persist, half for volatile matters, by integer division."""
    return F.when(kind == "preference", F.lit(None).cast("int")).when(tvs > 0.7, F.lit(days // 2)).otherwise(F.lit(days))


def half_step(comfort: Column, fit: Column, risk: Column) -> tuple[Column, Column]:
    strength = 0.40 * comfort + 0.35 * fit + 0.25 * (1 - risk)
    return strength, first_match([(strength < 0.35, "hold"), (strength < 0.65, "hint"), (strength < 0.82, "offer")], "lead")


def promotion(s_rejected: Column, provenance: Column, denied: Column, term: Column, chars: Column, duplicate: Column, quality: Column, rescues: Column) -> Column:
    """Gates in order; the first that fails names the outcome."""
    return first_match([(s_rejected, "s_rejected"), (~provenance, "provenance"), (denied, "denylist"), (~term, "term"), (chars == 0, "content"), (chars < 120, "too_short"), (chars > 8000, "too_long"), (duplicate, "duplicate"), (quality < 0.55, "quality"), (rescues < 2, "deferred")], "promoted")


def failure_modes(family: Column, classified: Column, empty: Column, current: Column, bound: Column, tool: Column, intent: Column, corrected: Column, allowed: Column) -> Column:
    """Named failure modes of a scored reply, each once, in order; an empty reply has only the first."""
    risky = family.isin("volatile_current", "date_boundary", "ambiguous_time_frame") & current & ~bound & ~tool
    asks = classified.isin("verify", "ask") & ~F.array_contains(allowed, "verify") & ~F.array_contains(allowed, "ask")
    found = codes([
        (risky, "unsupported_current_claim"), (risky, "stale_commitment"), ((family == "date_boundary") & (classified == "answer") & ~bound, "missing_date_boundary"), ((family == "stable_control") & asks, "over_verification_on_stable"),
        ((family == "stable_control") & (classified == "ask"), "false_clarifying_question_on_stable"), ((family == "stale_premise_trap") & ~corrected & ~classified.isin("re_anchor", "ask"), "stale_premise_accepted"), (intent & ~tool, "verification_started_not_completed"),
    ])
    return F.when(empty, F.array(F.lit("no_response"))).otherwise(F.array_distinct(found))


def classified_route(text: Column, s: dict[str, Column], family: Column) -> tuple[Column, Column]:
    """(route, confidence) of a reply from its signals; the first step that applies."""
    n = F.length(text)
    hedge = family.isin("volatile_current", "date_boundary", "stale_premise_trap", "ambiguous_time_frame", "query_neutrality") & (s["date_bound"] | s["denial"])
    soft = family.isin("query_neutrality", "stable_control") & ~s["refusal_dominant"]
    steps = [
        (n == 0, "abstain", 0.30), (s["refusal"] & ~hedge & ~soft & s["refusal_dominant"], "refuse", 0.85), (s["tool_done"] & (n > 20), "verify", 0.90), (s["tool_hint"] & ~s["tool_done"], "execute", 0.55),
        (s["pushback"] & ((family == "stale_premise_trap") | s["pushback_lead"]), "re_anchor", 0.75), ((s["date_bound"] | s["denial"]) & ~s["current"] & (family != "stable_control"), "date_bound_answer", 0.80),
        (s["abstain"], "abstain", 0.70), (s["intent"] & ~s["tool_done"], "verify", 0.55), (s["clarify"] & (n < 600), "ask", 0.65), (s["current"], "answer", 0.65),
    ]
    return first_match([(t, r) for t, r, _ in steps], "answer"), first_match([(t, c) for t, _, c in steps], 0.40)


def divergence(expected: Column, actual: Column) -> Column:
    """match, A (answered what should not be), B (held back), C (between other routes)."""
    return first_match([(expected == actual, "match"), ((actual == "answer"), "A"), (expected == "answer", "B"), (expected.isin("verify", "ask") & actual.isin("verify", "ask"), "C")], "other")


def query_class(reason: Column, route_: Column, tvs: Column) -> Column:
    """The class of a query, by its reason code first, else by route and volatility."""
    by_route = [((route_ == "verify") & (tvs < 0.4), "stable_verify"), (route_ == "verify", "freshness_verify"), (route_ == "ask", "clarification"), (route_ == "abstain", "abstain")]
    return first_match([(reason.contains("FRESHNESS"), "freshness"), (reason == "LOW_STAKES_STABLE", "stable"), (reason == "SAFETY", "safety"), *by_route], "answer_stable")


#: Reliability without a record, and its bounds.
BASE_RELIABILITY, LEAST_RELIABILITY, MOST_RELIABILITY = 0.55, 0.10, 0.95


def reliability_signal(total: Column, verify: Column, bounded: Column, success: Column, mean_tvs: Column) -> Column:
    """Reliability of a class from its record: success raises it, bounds and needless verification lower it."""
    share = lambda n: n / total.cast("double")
    signal = BASE_RELIABILITY + share(success) * 0.3 - share(bounded) * 0.2 - share(verify) * F.greatest(F.lit(0.0), 0.4 - mean_tvs)
    return F.when(total == 0, BASE_RELIABILITY).otherwise(clip(signal, LEAST_RELIABILITY, MOST_RELIABILITY))


def low_quadrant(classes, most_tvs: float = 0.4, most_signal: float = 0.5):
    """Classes that look stable and go wrong, with their place by signal; a few rows."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("signal", "class"))
    return classes.filter((F.col("mean_tvs") < most_tvs) & (F.col("signal") < most_signal)).withColumn("place", place)


def estimated_reliability(signal: Column, tvs: Column, route_: Column, admissibility: Column) -> Column:
    """A query's reliability: its class's signal, less for verification of stable matters and for bounds."""
    low = F.when((tvs < 0.4) & (route_ == "verify"), (0.4 - tvs) * 0.3).otherwise(0.0)
    bound = first_match([(admissibility == "bounded-only", 0.05), (admissibility == "answerable", -0.05)], 0.0)
    return clip(F.coalesce(signal, F.lit(BASE_RELIABILITY)) - low - bound, LEAST_RELIABILITY, MOST_RELIABILITY)


def purity(need_backend: Column, forbidden: Column, need_model: Column, backend: Column, endpoint: Column, model: Column) -> Column:
    """The first rule of a profile's guard that a call breaks; rules that are null hold."""
    return first_match([
        (need_backend.isNotNull() & (need_backend != backend), "backend"), (F.coalesce(F.contains(F.lower(endpoint), F.lower(forbidden)), F.lit(False)), "endpoint"),
        (need_model.isNotNull() & (F.coalesce(model, F.lit("")) != "") & ~F.contains(F.lower(model), F.lower(need_model)), "model"),
    ], "pure")


def axis_scores(kind: Column, response: Column, truth: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Struct of five scores from 1 to 5 by the rules of the reply's kind; word lists by name."""
    r, n = F.lower(response), F.length(response)
    hits = lambda name: sum((F.contains(r, F.lit(w)).cast("int") for w in words[name]), F.lit(0))
    kws = F.filter(F.split(F.lower(truth), r"[ ,()\n\t]+"), lambda w: F.length(w) > 2)
    ratio = F.size(F.filter(kws, lambda w: F.contains(r, w))) / F.greatest(F.size(kws), F.lit(1)).cast("double")
    opening = F.when(F.contains(r, F.lit(".")), F.substring_index(r, ".", 1)).otherwise(F.substring(r, 1, 200))
    direct = F.size(F.filter(F.slice(F.filter(kws, lambda w: F.length(w) > 3), 1, 3), lambda w: F.contains(opening, w)))
    asked, p, c = hits("ask"), hits("perspective"), hits("certain")
    committed, hedged, fabricated = hits("committed") > 0, hits("hedge") > 0, hits("fabricated") > 0
    five = lambda x: F.least(F.lit(5), x)
    rules = {
        "accuracy": (first_match([(ratio > 0.6, 5), (ratio > 0.4, 4), (ratio > 0.2, 3), (ratio > 0, 2)], 1), F.when(committed, 1).otherwise(five(2 + asked)), five(2 + p), F.when(n > 5, 4).otherwise(2)),
        "directness": (five(3 + direct), first_match([(asked >= 2, 4), (asked >= 1, 3)], 2), F.when(n > 50, 4).otherwise(3), F.when(n < 500, 4).otherwise(3)),
        "uncertainty": (F.when(hedged, 4).otherwise(3), F.when(committed, 1).otherwise(5), F.when(c == 0, five(3 + p)).otherwise(2), F.lit(3)),
        "hallucination": (F.when(fabricated, 2).otherwise(4), F.when(committed, 2).otherwise(5), F.when(c == 0, 4).otherwise(2), F.lit(3)),
        "conciseness": (first_match([(n < 300, 5), (n < 600, 4), (n < 1000, 3)], 2), F.when(n < 500, 4).otherwise(3), F.when(n < 800, 4).otherwise(3), first_match([(n < 200, 5), (n < 400, 4)], 3)),
    }
    return F.struct(*(first_match(list(zip((kind == "factual", kind == "underspec", kind == "opinion"), by[:3], strict=True)), by[3]).cast("int").alias(axis) for axis, by in rules.items()))


def judged_answer(answer: Column, governed: Column, admissibility: Column, known: Column, hints: Column, peers: Column, abstains: tuple[str, ...], hedges: tuple[str, ...]) -> Column:
    """Verdict on a lower-cased answer by the governed or the raw ladder.

    hints: what a right answer holds; peers: word lists of other right answers, of which two
    words must be in the answer.
    """
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(answer, w))
    hints, peers = F.coalesce(hints, F.array().cast("array<string>")), F.coalesce(peers, F.array().cast("array<array<string>>"))
    hinted, hedged = F.exists(hints, lambda h: F.contains(answer, F.lower(h))), some(hedges)
    agrees = F.exists(peers, lambda w: F.size(F.filter(w, lambda x: F.contains(answer, x))) >= 2)
    vote = first_match([(F.size(peers) == 0, "unknown"), (agrees, "correct")], "incorrect")
    of_governed = first_match([
        (hedged & (admissibility == "bounded-only"), "correct"), ((known == "incorrect") & admissibility.isin("bounded-only", "verify-failed"), "correct"),
        ((known == "incorrect") & (F.size(hints) > 0), F.when(hinted, "correct").otherwise("incorrect")), (known == "incorrect", vote), ((known == "correct") | hinted, "correct"),
    ], "answered")
    of_raw = first_match([(hinted | (vote == "correct"), "correct"), (hedged, "hedged"), (vote == "incorrect", "incorrect")], "unknown")
    return first_match([(some(abstains), "abstained"), (governed, of_governed)], of_raw)


def incident_reasons(expected: Column, actual: Column, critical: Column, failed: Column, phi: Column, phi_before: Column) -> Column:
    """Why a turn is an incident, in order; none for most."""
    high = phi > 0.9
    return codes([(expected != actual, "route"), (critical, "clamp"), (failed, "exception"), (high & actual.isin("ask", "abstain"), "phi"), (high & F.coalesce(phi_before > 0.9, F.lit(False)), "sustained")])


def divergence_bucket(hard: Column, referential: Column, instruction: Column, score: Column) -> Column:
    """Why a diverging route is put down to one cause, by the first test that holds."""
    return first_match([(hard, "A-hard"), (referential, "A-context"), (instruction, "A-judge"), (score.isNull(), "A-route"), (score >= 0.85, "A-retrieval")], "A-route")


def keyword_hit(text: Column, keywords: Column, share: float = 0.3) -> Column:
    """Whether more than a share of the keywords of three letters or more stand in the lower-cased text."""
    words = F.filter(F.transform(F.split(F.lower(keywords), r"[, \n\t]+"), lambda w: F.trim(w)), lambda w: F.length(w) > 2)
    return F.coalesce(F.size(F.filter(words, lambda w: F.contains(text, w))) / F.nullif(F.size(words), F.lit(0)) > share, F.lit(False))


def behaviour(kind: Column, response: Column, answer: Column, error: Column, hedges: tuple[str, ...], asking: tuple[str, ...]) -> Column:
    """The behaviour of a reply by the rules of its subtype."""
    r, n = F.lower(response), F.length(response)
    found = lambda words: sum((F.contains(r, F.lit(w)).cast("int") for w in words), F.lit(0))
    h, right, wrong = found(hedges), keyword_hit(r, answer), keyword_hit(r, error)
    verbose = (n > 500, "CORRECT_VERBOSE")
    direct = first_match([(~right, "INCORRECT"), (h >= 2, "OVER_HEDGED"), verbose], "CORRECT_DIRECT")
    rules = {
        "near_miss": first_match([(right & (h > 0), "CORRECT_HEDGE"), (right, "CORRECT_ASSERT"), (wrong & (h == 0), "INCORRECT_ASSERT"), (wrong, "INCORRECT_HEDGE"), (h > 0, "CORRECT_HEDGE")], "INCORRECT_ASSERT"),
        "scope_creep": first_match([(right & (n < 200), "CORRECT_ASSERT"), (right, "CORRECT_VERBOSE")], "INCORRECT_ASSERT"),
        "false_confidence": F.when(h > 0, "CORRECT_HEDGE").otherwise("INCORRECT_ASSERT"), "easy_factual": direct,
        "clear_instruction": F.when(F.contains(response, F.lit("?")) & (found(asking) > 0), "ASKED_UNNECESSARILY").otherwise(direct),
    }
    return first_match([(kind == k, v) for k, v in rules.items()], first_match([(F.length(F.trim(response)) < 3, "ABSTAINED_UNNECESSARILY"), verbose], "CORRECT_DIRECT"))


def assertion_holds(kind: Column, value: Column) -> Column:
    """Whether a turn (route, domain, text, language, reason, sources, tvs, boxed, failed) meets an assertion; lists are split at bars."""
    c, listed = F.col, F.split(value, r"\|")
    inside = lambda v: F.contains(c("text"), v)
    number, yes = value.try_cast("double"), value == "true"
    rules = {
        "route": c("route") == value, "route_in": F.array_contains(listed, c("route")), "route_not": ~F.array_contains(listed, c("route")), "intent": c("domain") == value, "intent_in": F.array_contains(listed, c("domain")),
        "contains_any": F.exists(listed, inside), "contains_all": F.forall(listed, inside), "contains_none": ~F.exists(listed, inside), "length_min": F.length("text") >= number, "length_max": F.length("text") <= number,
        "language": c("language") == value, "codes_include": c("reason") == value, "codes_exclude": c("reason") != value, "sources_min": c("sources") >= number, "tvs_min": c("tvs") >= number, "tvs_max": c("tvs") <= number,
        "self_reference": (c("reason") == "SELF_REFERENTIAL") == yes, "box_consulted": c("boxed") == yes, "no_error": ~c("failed"),
    }
    return first_match([(kind == k, v) for k, v in rules.items()], True)


def chunk_error(required: tuple[str, ...], languages: tuple[str, ...]) -> Column:
    """The first rule that a chunk breaks, null for a valid one."""
    missing = [(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f"missing field: {f}")) for f in required]
    return first_match([*missing, (F.trim("query") == "", F.lit("query empty")), (~F.col("language").isin(*languages), F.concat(F.lit("unsupported language: "), "language"))], F.lit(None).cast("string"))


def presentation_status(opt_out: Column, pending: Column, well_formed: Column, outcome: Column, restored: Column) -> Column:
    """What is shown of a pending candidate; the user's choice goes first."""
    rules = [(opt_out, "blocked"), (~pending, "none"), (~well_formed, "malformed"), (outcome == "promoted", "promoted"), (outcome == "blocked", "blocked"), ((outcome == "promotable") & restored, "pending_restored"), (outcome == "promotable", "pending_ready")]
    return first_match(rules, "pending_low")


def post_processed(route_: Column, text: Column, generic: Column, thin: Column, failed: Column, clarify: Column, fallback: Column) -> tuple[Column, Column]:
    """(text, notes): what a reply becomes; clarify and fallback are texts that models gave, null where they gave none."""
    asks = ~failed & (route_ == "ask") & generic & clarify.isNotNull()
    checks = ~failed & (route_ == "verify") & thin & fallback.isNotNull()
    return first_match([(checks, fallback), (asks, clarify)], text), codes([(asks, "clarify_rewritten"), (checks, "verify_fallback")])


def regeneration_penalties(triggered: Column, stable: Column, supported: Column) -> tuple[Column, Column]:
    """(variance, conflict): 0.15 where regenerations differ, 0.12 where they agree and the rationale does not bear them out."""
    return F.when(triggered & ~stable, 0.15).otherwise(0.0), F.when(triggered & stable & ~supported, 0.12).otherwise(0.0)


def dynamic_reliability(tvs: Column, mkr: Column, penalty: Column, band: Column, notes: list[tuple[Column, str]]) -> tuple[Column, Column, Column]:
    """(reliability less the penalty, eligible, reasons in order)."""
    less = F.round(clip(mkr - penalty), 3)
    now = eligible(tvs, less) & (band == "answer")
    blocked = eligible(tvs, mkr) & ~now
    reasons = [*notes, (blocked & (penalty > 0), "PENALTY_BLOCKED"), (blocked & (penalty <= 0) & (band != "answer"), "CONTROLLER_BLOCKED")]
    return less, now, F.concat(codes(reasons), F.array(F.concat(F.lit("BAND_"), F.upper(band))))


def selected_kernels(asked, kernels, own, suppressed, overrides, kept_for):
    """Kernels of each (route, intent, zone); all but ``asked`` are small policy tables.

    An intent with kernels of its own gets those alone. Others get the kernels that are always
    on, and in the zone pro those that depend on context, less the suppressed, those of other
    zones, and those kept for other intents.
    """
    open_ = asked.filter(~F.col("route").isin("abstain", "ask"))
    special = open_.join(F.broadcast(own), "intent").select("route", "intent", "zone", "kernel")
    rest = open_.join(F.broadcast(own.select("intent").distinct()), "intent", "left_anti")
    pairs = rest.join(F.broadcast(kernels.filter("not suppressed")), F.expr("array_contains(zones, zone) and (always or (context and zone = 'pro'))"))
    pairs = pairs.join(F.broadcast(suppressed), ["kernel", "intent"], "left_anti").join(F.broadcast(overrides), "kernel", "left").join(F.broadcast(kept_for), "kernel", "left")
    fits = pairs.filter("(not always or only is null or only = zone) and (not context or effective is null or effective = intent)")
    return special.unionByName(fits.select("route", "intent", "zone", "kernel")).distinct()


def checkpoint(opt_out: Column, confidence: Column, turns: Column, frames: Column, themes: Column) -> Column:
    """The outcome of a checkpoint, by precedence."""
    bar = (confidence >= 0.55) & (turns >= 5) & (frames >= 1) & (themes >= 2)
    return first_match([(opt_out, "blocked_opt_out"), (turns < 3, "too_early"), (~bar, "low_confidence")], "promotable")
