from postlab.functions.exprs import (  # noqa: F401
    finite, safe_div, bounded_broadcast, month_number, numeric_columns, text_columns,
)
