from retailflow.functions.scalars import (  # noqa: F401
    age_group,
    day_of_ms,
    day_of_text,
    gender_name,
    hour_of_ms,
    hour_of_text,
    name_id,
    number_id,
    previous_day,
    round_half_up,
    to_cents,
    topic_name,
    words,
)
