"""Composed plans and the registered queries (importing this package registers them)."""

from codetrail.plans import q_history  # noqa: F401
from codetrail.plans import q_diffs  # noqa: F401
from codetrail.plans import q_replace  # noqa: F401
from codetrail.plans import q_facts  # noqa: F401
from codetrail.plans import q_sources  # noqa: F401
from codetrail.plans import q_deps  # noqa: F401
from codetrail.plans import q_misc  # noqa: F401
