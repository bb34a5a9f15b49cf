"""Signals of recognised text, score boosts and label decisions; all map-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies.
SCREEN_TERMS = "whatsapp telegram instagram facebook settings configuración ajustes notificaciones notifications buscar search enviar send mensaje messages mensajes batería battery wifi contactos contacts inicio home publicar comentarios comments".split()
MEME_TERMS = "pov meme memes jajaja jajajaja lol nadie cuando literal expectativa realidad expectation reality".split()
DOCUMENT_TERMS = "factura recibo invoice receipt subtotal importe impuesto tax documento document asunto subject firma signature contrato contract".split()
CATEGORIES = "animals documents food memes objects other people screenshots".split()
# Minimum, uncertain minimum, uncertain margin, secondary margin.
SENSITIVITY = {"conservative": (0.255, 0.27, 0.024, 0.015), "balanced": (0.225, 0.24, 0.018, 0.025), "broad": (0.21, 0.23, 0.015, 0.04)}
SCORES = "array<struct<category:string,score:double>>"


def term_count(text: Column, vocabulary: list[str], pieces: int = 2000) -> Column:
    """How many distinct terms are among the first pieces between characters other than letters and digits."""
    words = F.transform(F.slice(F.split(text, r"[^\p{L}\p{N}]"), 1, pieces), F.lower)
    return F.size(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, vocabulary))))


def text_signals(text: Column, lines: Column, words: Column, coverage: Column, screen=SCREEN_TERMS, meme=MEME_TERMS, document=DOCUMENT_TERMS) -> Column:
    finite = coverage.isNotNull() & ~F.isnan(coverage) & (F.abs(coverage) != float("inf"))
    cover = F.when(finite, F.least(F.greatest(coverage, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.struct(F.least(lines, F.lit(500)).alias("line_count"), F.least(words, F.lit(2000)).alias("word_count"), cover.alias("coverage"), term_count(text, screen).alias("screen"), term_count(text, meme).alias("meme"), term_count(text, document).alias("document"))


def boost_text_scores(scores: Column, s: Column, width: Column, height: Column) -> Column:
    enough = (s["word_count"] >= 4) & (s["line_count"] >= 2) & (s["coverage"] > 0.001)
    tall = (width > 0) & (height / width >= 1.5)
    screen = (s["screen"] >= 2) | ((s["screen"] >= 1) & tall & (s["line_count"] >= 5))
    paper = ((s["document"] >= 2) & (s["word_count"] >= 15)) | ((s["line_count"] >= 9) & (s["word_count"] >= 45) & (s["coverage"] >= 0.08))
    joke = (s["meme"] >= 2) & (s["line_count"] <= 12) & (s["word_count"] <= 90) & ~paper & ~screen

    def boosted(c: Column) -> Column:
        by = F.when((c["category"] == "screenshots") & screen, 0.04).when((c["category"] == "documents") & paper, 0.035).when((c["category"] == "memes") & joke, 0.03).otherwise(0.0)
        new = F.when(enough & (by > 0) & (c["score"] >= 0.17) & ~F.isnan(c["score"]), F.least(c["score"] + by, F.lit(1.0))).otherwise(c["score"])
        return F.struct(c["category"].alias("category"), new.alias("score"))

    return F.transform(scores, boosted)


def ranked_scores(scores: Column, categories=CATEGORIES) -> Column:
    """Each known category's largest finite score between 0 and 1, best first, ties by name."""
    valid = lambda c: c["score"].isNotNull() & ~F.isnan(c["score"]) & (F.abs(c["score"]) != float("inf"))

    def best(name: str) -> Column:
        own = F.filter(scores, lambda c: (c["category"] == name) & valid(c))
        top = F.aggregate(own, F.lit(0.0), lambda a, c: F.greatest(a, F.least(c["score"], F.lit(1.0))))
        return F.struct((-top).alias("order"), F.lit(name).alias("category"), top.alias("score"))

    return F.transform(F.array_sort(F.array(*map(best, categories))), lambda c: F.struct(c["category"].alias("category"), c["score"].alias("score")))


def decide_labels(ranked: Column, sensitivity: str = "balanced") -> Column:
    """(categories, uncertain) from ranked scores."""
    least, unsure, margin, second = SENSITIVITY[sensitivity]
    best = ranked[0]
    other = (best["score"] < least) | (best["category"] == "other")
    kept = F.slice(F.filter(ranked, lambda c: (c["category"] != "other") & (c["score"] >= least) & (c["score"] >= best["score"] - second)), 1, 3)
    names = F.when(other, F.array(F.lit("other"))).otherwise(F.transform(kept, lambda c: c["category"]))
    return F.struct(names.alias("categories"), ((best["score"] < unsure) | (best["score"] - ranked[1]["score"] < margin) | (best["category"] == "other")).alias("uncertain"))


def merge_view_scores(whole: Column, details: Column) -> Column:
    """0.8 of the whole view, 0.1 of the details' mean and 0.1 of their best; without details the whole view."""
    n = F.size(details)
    total = F.aggregate(details, F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, 0.8 * whole + 0.1 * total / n + 0.1 * F.array_max(details)).otherwise(whole)
