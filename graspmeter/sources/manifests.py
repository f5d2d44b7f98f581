"""Project profile from manifest files: language, framework and what a project uses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Package names that decide the profile.
JS_FRAMEWORKS = [("next", "Next.js"), ("express", "Express"), ("fastify", "Fastify"), ("react", "React")]
JS_FLAGS = {
    "has_auth": ["passport", "jsonwebtoken", "bcrypt", "next-auth"],
    "has_payments": ["stripe", "razorpay"],
    "has_database": ["prisma", "mongoose", "pg", "mysql2", "sequelize"],
    "has_testing": ["jest", "vitest", "mocha", "cypress"],
}
PY_FRAMEWORKS = [("django", "Django"), ("flask", "Flask"), ("fastapi", "FastAPI")]
PY_FLAGS = {
    "has_auth": ["django-allauth", "python-jose"],
    "has_payments": ["stripe"],
    "has_database": ["sqlalchemy", "django"],
    "has_testing": ["pytest", "unittest"],
}

_MANIFESTS = ["package.json", "tsconfig.json", "requirements.txt", "pyproject.toml"]
_PACKAGE = "struct<dependencies: map<string,string>, devDependencies: map<string,string>>"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def project_profiles(manifests: DataFrame) -> DataFrame:
    """One row per project from ``manifests(project, file_name, content)``.

    ``package.json`` comes first, then ``requirements.txt``, then ``pyproject.toml``. The four
    root manifests are pre-aggregated per project in one pass; a project's other files only make
    it appear. Of several manifests of one name the greatest text counts.
    """
    one = manifests.groupBy("project").agg(
        *[
            F.max(F.when(F.col("file_name") == name, F.col("content"))).alias(alias)
            for name, alias in zip(_MANIFESTS, ("package", "tsconfig", "requirements", "pyproject"))
        ]
    )
    package = F.from_json("package", _PACKAGE, {"mode": "PERMISSIVE"})
    empty = F.create_map().cast("map<string,string>")
    parsed = one.withColumn("package_doc", package).withColumn(
        "deps",
        F.map_from_entries(
            F.concat(
                F.map_entries(F.coalesce("package_doc.dependencies", empty)),
                F.filter(
                    F.map_entries(F.coalesce("package_doc.devDependencies", empty)),
                    lambda e: ~F.coalesce(
                        F.map_contains_key(F.coalesce("package_doc.dependencies", empty), e["key"]),
                        F.lit(False),
                    ),
                ),
            )
        ),
    )
    has_package = F.col("package").isNotNull()
    readable = F.get_json_object("package", "$").isNotNull()
    text = F.coalesce("requirements", "pyproject")

    def dep(name: str) -> Column:
        return F.coalesce(F.element_at("deps", name), F.lit("")) != ""

    def word(name: str) -> Column:
        return F.coalesce(text.contains(name), F.lit(False))

    js_framework = F.coalesce(*[F.when(dep(n), F.lit(v)) for n, v in JS_FRAMEWORKS])
    py_framework = F.coalesce(*[F.when(word(n), F.lit(v)) for n, v in PY_FRAMEWORKS])
    language = (
        F.when(has_package & readable & F.col("tsconfig").isNull(), "javascript")
        .when(has_package, "typescript")
        .when(text.isNotNull(), "python")
        .otherwise("unknown")
    )
    profile = parsed.select(
        "project",
        language.alias("primary_language"),
        F.when(has_package, js_framework).otherwise(py_framework).alias("framework"),
        *[
            F.when(has_package, _any([dep(n) for n in JS_FLAGS[flag]]))
            .otherwise(_any([word(n) for n in PY_FLAGS[flag]]))
            .alias(flag)
            for flag in JS_FLAGS
        ],
    )
    return profile.select(
        "project",
        F.coalesce("primary_language", F.lit("unknown")).alias("primary_language"),
        "framework",
        *[F.coalesce(F.col(flag), F.lit(False)).alias(flag) for flag in JS_FLAGS],
    )
