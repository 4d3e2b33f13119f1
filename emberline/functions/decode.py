"""Decoding numbers that logs print: error numbers, exception syndromes, interrupts, cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Linux error numbers, PSCI return codes and AArch64 exception classes, from their public specifications.
ERRNO = {
    1: "EPERM", 2: "ENOENT", 3: "ESRCH", 4: "EINTR", 5: "EIO", 6: "ENXIO", 9: "EBADF", 11: "EAGAIN", 12: "ENOMEM", 13: "EACCES", 14: "EFAULT", 16: "EBUSY",
    17: "EEXIST", 19: "ENODEV", 20: "ENOTDIR", 22: "EINVAL", 28: "ENOSPC", 32: "EPIPE", 34: "ERANGE", 38: "ENOSYS", 61: "ENODATA", 62: "ETIME", 71: "EPROTO",
    95: "EOPNOTSUPP", 110: "ETIMEDOUT", 517: "EPROBE_DEFER",
}
PSCI = {
    0: "SUCCESS", -1: "NOT_SUPPORTED", -2: "INVALID_PARAMETERS", -3: "DENIED", -4: "ALREADY_ON", -5: "ON_PENDING", -6: "INTERNAL_FAILURE",
    -7: "NOT_PRESENT", -8: "DISABLED", -9: "INVALID_ADDRESS",
}
EXCEPTION_CLASS = {
    0x00: "unknown", 0x01: "trapped wfi/wfe", 0x07: "fp/simd access", 0x0E: "illegal execution state", 0x11: "svc (aarch32)", 0x15: "svc", 0x16: "hvc", 0x17: "smc",
    0x18: "system register access", 0x20: "instruction abort, lower level", 0x21: "instruction abort, same level", 0x22: "pc alignment",
    0x24: "data abort, lower level", 0x25: "data abort, same level", 0x26: "sp alignment", 0x2C: "fp exception", 0x2F: "serror",
    0x30: "breakpoint, lower level", 0x31: "breakpoint, same level", 0x32: "step, lower level", 0x3C: "brk",
}
FAULT = {
    0x00: "address size, level 0", 0x01: "address size, level 1", 0x02: "address size, level 2", 0x03: "address size, level 3", 0x04: "translation, level 0",
    0x05: "translation, level 1", 0x06: "translation, level 2", 0x07: "translation, level 3", 0x09: "access flag, level 1", 0x0A: "access flag, level 2",
    0x0B: "access flag, level 3", 0x0D: "permission, level 1", 0x0E: "permission, level 2", 0x0F: "permission, level 3", 0x10: "synchronous external abort",
    0x11: "tag check", 0x21: "alignment",
}
SEVERITIES = ("emerg", "alert", "crit", "err", "warn", "notice", "info", "debug", "unknown")


def _looked_up(names: dict[int, str], key: Column) -> Column:
    pairs = [x for k, v in names.items() for x in (F.lit(k).cast("long"), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key.cast("long"))


def errno(value: Column) -> Column:
    """The name of a (negated) error number."""
    return _looked_up(ERRNO, F.abs(value))


def psci(value: Column) -> Column:
    return _looked_up(PSCI, value)


def exception_class(syndrome: Column) -> Column:
    return _looked_up(EXCEPTION_CLASS, F.shiftright(syndrome.cast("long"), 26).bitwiseAND(0x3F))


def fault_status(syndrome: Column) -> Column:
    """The fault of an instruction or data abort; null for other classes."""
    kind = F.shiftright(syndrome.cast("long"), 26).bitwiseAND(0x3F)
    return F.when(kind.isin(0x20, 0x21, 0x24, 0x25), _looked_up(FAULT, syndrome.cast("long").bitwiseAND(0x3F)))


def interrupt(gic_id: Column) -> Column:
    """SGI, PPI or SPI with its number; SPIs count from 32."""
    n = gic_id.cast("long")
    return (
        F.when((n < 0) | (n >= 1020), None)
        .when(n < 16, F.concat(F.lit("SGI "), n.cast("string")))
        .when(n < 32, F.concat(F.lit("PPI "), (n - 16).cast("string")))
        .otherwise(F.concat(F.lit("SPI "), (n - 32).cast("string")))
    )


def severity_name(value: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), value.cast("int"))


def severity_value(name: Column) -> Column:
    """0 (worst) to 7; 8 for what isn't known."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(name)).cast("int")
    return F.when(at > 0, at - 1).otherwise(8)


def cursor(device: Column, offset: Column) -> Column:
    """token:offset, a position in a device's stream; the token is 12 hex digits of the device's hash."""
    return F.concat(F.substring(F.sha2(device.cast("string"), 256), 1, 12), F.lit(":"), F.lpad(F.lower(F.hex(offset.cast("long"))), 16, "0"))


def cursor_offset(text: Column, device: Column, horizon: Column) -> Column:
    """state (ok, invalid, expired) and offset of a cursor for a device whose data begin at ``horizon``."""
    shaped = text.rlike("^[0-9a-f]{12}:[0-9a-f]{16}$") & (F.substring_index(text, ":", 1) == F.substring(F.sha2(device.cast("string"), 256), 1, 12))
    offset = F.conv(F.substring_index(text, ":", -1), 16, 10).cast("long")
    state = F.when(~shaped, "invalid").when(offset < horizon, "expired").otherwise("ok")
    return F.struct(state.alias("state"), F.when(shaped, offset).alias("offset"))
