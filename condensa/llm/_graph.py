"""Connected components are of the whole library."""

from ..operators.components import components  # noqa: F401
