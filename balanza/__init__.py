"""balanza: case-load analytics on Spark DataFrames.

The package answers questions about yearly case counts (cases filed and cases
attended, by place, subject, office type and year).  Every operator takes and
returns lazy DataFrames; Spark decides the physical plan.
"""

from balanza.esquema import SENTINELA, RolesColumnas, esquema_crudo

__all__ = ["SENTINELA", "RolesColumnas", "esquema_crudo"]
