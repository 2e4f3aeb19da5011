"""vulnlake: code-security findings analytics on Spark.

Operators take and return DataFrames; scalar rules are Column expressions.
Nothing here contacts a target: all inputs are recorded tables.
"""

from vulnlake.session import build_session, ensure_checkpoint_dir
from vulnlake.functions.registration import register

__all__ = ["build_session", "ensure_checkpoint_dir", "register"]
