"""Rubrics as three small dimensions: rubric(doc_type, max_total), criterion and id_category, each with its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Criteria (key, label, max, group) and categories of cited items (key, label) by document type.
CRITERIA = {
    "srs": [
        ("intro", "Introduction & descriptive sections", 2, None),
        ("requirements", "Functional & non-functional requirements", 6, None),
        ("uml", "UML use case diagram", 2, None),
        ("security", "Security section", 2, None),
    ],
    "test_plan": [
        ("intro", "Introduction & descriptive sections", 2, None),
        ("core_sections", "Sections 3/4/5 (Features to/not to be tested, Test Approach)", 4, None),
        ("security_validation", "Section 5.1 Security Validation", 1, None),
        ("traceability", "Traceability to SRS (RTM)", 1, None),
        ("test_case_coverage", "Test case coverage (>=7-10, FR+NFR)", 5, None),
    ],
    "sads": [
        ("component_diagram", "Component diagram & description", 4, "Architecture"),
        ("arch_pattern", "Architecture pattern", 2, "Architecture"),
        ("arch_traceability", "Traceability to requirements", 1, "Architecture"),
        ("arch_security", "Security architecture", 2, "Architecture"),
        ("arch_other", "Other architecture sections", 1, "Architecture"),
        ("sequence_diagrams", "UML sequence diagrams (>=2)", 4, "Design"),
        ("api_design", "API design", 3, "Design"),
        ("error_handling", "Error handling", 2, "Design"),
        ("design_other", "Other design sections", 1, "Design"),
    ],
}
CATEGORIES = {
    "srs": [
        ("functional_requirements", "Functional Requirements"),
        ("non_functional_requirements", "Non-Functional Requirements"),
        ("security_objectives", "Security Objectives"),
        ("security_requirements", "Security Requirements"),
    ],
    "test_plan": [
        ("test_case_ids", "Test Case IDs"),
        ("srs_requirement_ids_referenced", "SRS Requirement IDs referenced (traceability)"),
        ("security_validation_items", "Security Validation items"),
    ],
    "sads": [
        ("requirement_ids_referenced", "Requirement IDs referenced (traceability)"),
        ("api_endpoints", "API endpoints"),
        ("components", "Components named"),
    ],
}
DOC_TYPES = list(CRITERIA)


def criteria(spark: SparkSession) -> DataFrame:
    rows = [(d, k, *c) for d, cs in CRITERIA.items() for k, c in enumerate(cs)]
    return spark.createDataFrame(rows, "doc_type string, ord int, key string, label string, max int, `group` string")


def categories(spark: SparkSession) -> DataFrame:
    rows = [(d, k, *c) for d, cs in CATEGORIES.items() for k, c in enumerate(cs)]
    return spark.createDataFrame(rows, "doc_type string, ord int, key string, label string")


def rubrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, sum(c[2] for c in cs)) for d, cs in CRITERIA.items()], "doc_type string, max_total int")


def check_doc_type(doc_type: str) -> str:
    if doc_type not in CRITERIA:
        raise ValueError(f"doc_type must be one of {DOC_TYPES}")
    return doc_type
