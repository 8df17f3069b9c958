"""The one exception type raised when data breaks a contract."""


class ContractError(ValueError):
    """Input data, a path or a parameter violates a documented contract."""
