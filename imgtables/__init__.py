"""PySpark operators and jobs for large tables of paired images."""

from .errors import ContractError
from .session import checkpoint_root, configure, materialize

__all__ = ["ContractError", "checkpoint_root", "configure", "materialize"]
