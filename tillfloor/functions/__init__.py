from tillfloor.functions.exprs import (  # noqa: F401
    batch_key,
    day_name,
    exact_round,
    half_even,
    hours_sum,
    is_sunday,
    line_count,
    minutes_sum,
    money,
    money_round,
    money_sum,
    month_start,
    plus_minutes,
    ratio,
    revenue_sum,
)
from tillfloor.functions.ordered import exact_quantiles, global_ranks, total_before  # noqa: F401
