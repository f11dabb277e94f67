"""irforge: retrieval training-data and evaluation jobs written as Spark DataFrame plans.

Every public function takes and returns DataFrames (or Column expressions) so that Catalyst
sees one lazy plan; nothing pulls a table through the driver.
"""

from irforge.session import build_session, ensure_checkpoint_dir, materialize

__all__ = ["build_session", "ensure_checkpoint_dir", "materialize"]
