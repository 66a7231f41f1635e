"""All queries over the driver's tables, by name, and the SQL they are held against."""

from assay.plans import derived, relational

QUERIES = relational.QUERIES | derived.QUERIES
ORACLE_SQL = relational.ORACLE_SQL | derived.ORACLE_SQL
