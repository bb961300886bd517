from basketlens.functions.core import (  # noqa: F401
    bin_expr,
    bin_ordinal,
    bool_int,
    first_match,
    flag,
    mean,
    numeric_text,
    ordered_domain,
    pround,
    recode,
    safe_div,
    total,
)
