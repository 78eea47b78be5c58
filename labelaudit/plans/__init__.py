"""Every query of the library; importing this package registers them."""

from labelaudit.plans import audit_queries, data_queries, other_queries, rule_queries, scan_queries, text_queries  # noqa: F401
from labelaudit.plans.registry import QUERIES, SQL  # noqa: F401
