"""What a model is told: the topics of a matrix, and a document's title and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lines of a prompt.
NO_TOPICS, NO_TITLE, NO_METADATA = "(sin temas activos en la matriz)", "(sin título)", "(ninguno)"
DESCRIPTION, CRITERION, KEYWORDS = "Descripción", "Criterio de relevancia", "Palabras clave (señales auxiliares)"
FULL, EXCERPT_NOTICE, EXCERPT = "Contenido completo:\n", "[AVISO: Contenido completo no disponible. Se proporciona extracto.]\n", "Extracto: "
NOTHING_NOTICE, TITLE, METADATA = "[AVISO: Contenido completo y extracto no disponibles.]\n", "Título: ", "\nMetadatos disponibles:\n"


def filled(c: Column) -> Column:
    """Null of an empty text."""
    return F.nullif(c, F.lit(""))


def topic_line(code: Column, name: Column, description: Column, criterion: Column, keywords: Column) -> Column:
    """A topic's line, and below it those of what is given of it."""
    below = lambda label, c: F.concat(F.lit(f"\n    {label}: "), filled(c))
    empty = F.lit("")
    head = F.concat(F.lit("  - "), F.coalesce(code, empty), F.lit(" | "), F.coalesce(name, empty))
    rest = [below(DESCRIPTION, description), below(CRITERION, criterion), below(KEYWORDS, F.array_join(keywords, ", "))]
    return F.concat(head, *[F.coalesce(c, empty) for c in rest])


def topic_blocks(matrices: DataFrame, topics: DataFrame) -> DataFrame:
    """(matrix, block): the lines of each matrix's topics (matrix, code, name, description, criterion, keywords, position), by position and code.

    A matrix is configuration, of some hundred topics. One without topics says so.
    """
    line = topic_line(*[F.col(c) for c in ("code", "name", "description", "criterion", "keywords")])
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "code", line.alias("line")))), lambda t: t["line"]), "\n")
    own = topics.groupBy("matrix").agg(block.alias("block"))
    return matrices.select("matrix").join(own, "matrix", "left").select("matrix", F.coalesce("block", F.lit(NO_TOPICS)).alias("block"))


def document_section(title: Column, content: Column, excerpt: Column, metadata: Column, most: int) -> Column:
    """struct(title, section, n_chars, error): the content, else the excerpt, else the title and metadata with a notice. A content of over ``most`` characters is an
    error and no section: texts are not cut. White space alone is a content."""
    empty = F.lit("")
    body = F.coalesce(content, empty)
    large = F.length(body) > most
    rest = F.concat(F.lit(NOTHING_NOTICE + TITLE), F.coalesce(title, empty), F.lit(METADATA), F.coalesce(filled(metadata), F.lit(NO_METADATA)))
    brief = F.concat(F.lit(EXCERPT_NOTICE + EXCERPT), excerpt)
    section = F.when(large, None).when(body != "", F.concat(F.lit(FULL), body)).when(F.coalesce(excerpt, empty) != "", brief).otherwise(rest)
    named = F.coalesce(filled(title), F.lit(NO_TITLE))
    return F.struct(named.alias("title"), section.alias("section"), F.length(section).alias("n_chars"), F.when(large, "input_too_large").alias("error"))
