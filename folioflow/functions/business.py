"""Columns over users, contracts and payments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The free tier and the price of a page.
FREE_LIMIT, PAGE_COST, TRIAL_LIMIT = 3, 10, 3
#: Roles and their ranks, states of contracts, words that a gateway uses for paid.
PRIVILEGED = ("admin", "super_user")
RANKS = {"user": 1, "admin": 2, "super_user": 3}
ENTERPRISE_STATUS = ("paid", "partial_paid", "due")
PAID_WORDS = ("successful", "success", "1", "200")


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at both ends, of whatever kind."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def at_least_zero(c: Column) -> Column:
    return F.greatest(F.lit(0), c)


def free_remaining(used: Column) -> Column:
    return at_least_zero(FREE_LIMIT - zero(used))


def pages_remaining(total: Column, used: Column) -> Column:
    return at_least_zero(zero(total) - zero(used))


def privileged(role: Column) -> Column:
    return role.isin(*PRIVILEGED)


def quota_state(role: Column, free_used: Column, total: Column, used: Column) -> Column:
    """unlimited, free, paid or exhausted."""
    return F.when(privileged(role), "unlimited").when(free_remaining(free_used) > 0, "free").when(pages_remaining(total, used) > 0, "paid").otherwise("exhausted")


def quota_message(state: Column, free: Column, pages: Column) -> Column:
    # The service's words.
    return (
        F.when(state == "unlimited", "Unlimited OCR access (admin / super-user).")
        .when(state == "free", F.concat(F.lit("You have "), free.cast("string"), F.lit(" free OCR request(s) remaining.")))
        .when(state == "paid", F.concat(F.lit("You have "), pages.cast("string"), F.lit(" subscription page(s) remaining.")))
        .otherwise("You have used all your free OCR requests and your subscription pages are exhausted. Please subscribe to continue.")
    )


def quota_snapshot(role: Column, free_used: Column, total: Column, used: Column) -> dict[str, Column]:
    """A user's quota as columns: limits, uses, what remains, and the message. Privileged users show none used and none bought."""
    free, pages, above = free_remaining(free_used), pages_remaining(total, used), privileged(role)
    mine = lambda c, other: F.when(above, other).otherwise(c)
    return {
        "free_ocr_limit": F.lit(FREE_LIMIT), "free_ocr_used": mine(zero(free_used), 0), "free_ocr_remaining": mine(free, FREE_LIMIT), "subscription_pages_total": mine(zero(total), 0),
        "subscription_pages_used": mine(zero(used), 0), "subscription_pages_remaining": mine(pages, 0), "has_active_subscription": ~above & (pages > 0), "can_do_ocr": above | (free > 0) | (pages > 0),
        "message": quota_message(quota_state(role, free_used, total, used), free, pages),
    }


def page_cost(pages: Column) -> Column:
    return pages * PAGE_COST


def duration_days(start: Column, end: Column) -> Column:
    return F.when(end >= start, F.datediff(end, start))


def contract_due(total_cost: Column, advance: Column, clamp: bool) -> Column:
    due = total_cost - advance
    return F.greatest(F.lit(0.0), due) if clamp else due


def payment_status(due: Column, advance: Column) -> Column:
    return F.when(due <= 0, "paid").when(F.coalesce(advance, F.lit(0.0)) > 0, "partial_paid").otherwise("due")


def unit_price(amount: Column, pages: Column) -> Column:
    return F.coalesce(amount / F.nullif(pages, F.lit(0)), F.lit(0.0))


def contract_invoice(id_: Column) -> Column:
    return F.format_string("ENT-%06d", id_)


def payment_invoice(user_id: Column, key: Column) -> Column:
    """user-HEX: twelve hexadecimal digits of the key's hash."""
    return F.concat(user_id.cast("string"), F.lit("-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 12)))


def invoice_user(invoice: Column) -> Column:
    return F.try_to_number(F.split_part(invoice, F.lit("-"), F.lit(1)), F.lit("9999999999")).cast("long")


def display_name(full_name: Column, username: Column) -> Column:
    return F.coalesce(F.nullif(full_name, F.lit("")), username)


def fingerprint(ip: Column, language: Column, screen: Column) -> Column:
    known = [F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in (ip, language, screen)]
    return F.sha2(F.concat_ws("|", *known).cast("binary"), 256)


def username_base(full_name: Column, email: Column) -> Column:
    raw = F.coalesce(F.replace(F.nullif(full_name, F.lit("")), F.lit(" "), F.lit("_")), F.split_part(email, F.lit("@"), F.lit(1)))
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(raw, "[^a-zA-Z0-9_]", ""), 1, 40), F.lit("")), F.lit("user"))


def rank(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[role], F.lit(0))


def permitted(role: Column, needed: Column) -> Column:
    return rank(role) >= rank(needed)


def trial_attempt(blocked: Column, used: Column, most: Column) -> Column:
    """struct(allowed, usage_count, remaining, message) of one more use of a trial device."""
    open_, after = ~blocked & (used < most), used + 1
    left = most - after
    # The service's words.
    message = (
        F.when(blocked, "Your device has been blocked. Please contact support or register for an account.")
        .when(used >= most, "Free trial limit reached. Please register to continue using our service.")
        .when(left == 0, "This was your last free trial. Please register to continue.")
        .when(left == 1, "You have 1 free trial remaining. Register to get unlimited access.")
        .otherwise(F.concat(F.lit("You have "), left.cast("string"), F.lit(" free trials remaining.")))
    )
    return F.struct(open_.alias("allowed"), F.when(open_, after).otherwise(used).alias("usage_count"), F.when(open_, left).otherwise(0).alias("remaining"), message.alias("message"))


def local_time(at: Column, offset: Column, abbreviation: Column) -> tuple[Column, Column]:
    """Date and time of day of a UTC time at an offset in seconds, with the zone's abbreviation then."""
    there = F.timestamp_seconds(F.unix_seconds(at) + offset)
    return F.date_format(there, "MMMM dd, yyyy"), F.concat(F.date_format(there, "hh:mm a "), abbreviation)
