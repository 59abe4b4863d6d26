"""Packet metadata out of binary IPv4 packets and Ethernet frames.

Header fields are read with column expressions; the payload is never kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.plan import computed_once

SIZE_RELEASE_COMPATIBLE = "release-compatible"
SIZE_IP_PACKET = "ip-packet"

# Header sizes, protocol and link-layer numbers.
ICMP, TCP, UDP = 1, 6, 17
_IP_HEADER, _TCP_HEADER, _UDP_HEADER, _ICMP_HEADER = 20, 20, 8, 4
_ETHERNET_HEADER, _VLAN_TAG = 14, 4
_IPV4, _VLAN, _PROVIDER_VLAN = 0x0800, 0x8100, 0x88A8


def _uint(raw: Column, start: Column | int, length: int) -> Column:
    """Big-endian unsigned integer at a zero-based byte position."""
    at = (F.lit(start) if isinstance(start, int) else start) + 1
    part = F.substring(raw, at.cast("int"), F.lit(length))
    return F.conv(F.hex(part), 16, 10).cast("int")


def _address(raw: Column, start: int) -> Column:
    return F.concat_ws(".", *[_uint(raw, start + i, 1).cast("string") for i in range(4)])


def decode_ipv4(
    rows: DataFrame, *, raw: str = "raw", size_policy: str = SIZE_RELEASE_COMPATIBLE
) -> DataFrame:
    """Decode raw IPv4 bytes into packet fields; ``reason`` is null when decoded.

    Reasons are checked in header order.  The release-compatible size of a UDP
    packet is its datagram length, of any other packet the IP length.
    """
    if size_policy not in (SIZE_RELEASE_COMPATIBLE, SIZE_IP_PACKET):
        raise ValueError(f"unknown size policy {size_policy!r}")
    b = F.col(raw)
    total = F.coalesce(F.octet_length(b), F.lit(0))
    first = _uint(b, 0, 1)
    header = first.bitwiseAND(F.lit(15)) * 4
    fragment = _uint(b, 6, 2)
    fields = rows.withColumns(
        {
            "_total": total,
            "_version": F.shiftright(first, 4),
            "_header": header,
            "_length": _uint(b, 2, 2),
            # more-fragments flag and fragment offset
            "_fragment": fragment.bitwiseAND(F.lit(0x3FFF)),
            "protocol": _uint(b, 9, 1),
        }
    )
    # A zero length field leaves the rest of the buffer as the IP payload.
    payload = (
        F.when(F.col("_length") == 0, F.col("_total")).otherwise(F.col("_length"))
        - F.col("_header")
    )
    needed = (
        F.when(F.col("protocol") == TCP, F.lit(_TCP_HEADER))
        .when(F.col("protocol") == UDP, F.lit(_UDP_HEADER))
        .otherwise(F.lit(_ICMP_HEADER))
    )
    tcp_offset = F.shiftright(_uint(b, F.col("_header") + 12, 1), 4) * 4
    reason = (
        F.when(F.col("_total") == 0, F.lit("empty"))
        .when(F.col("_version") != 4, F.lit("ip_version"))
        .when(
            (F.col("_total") < _IP_HEADER) | (F.col("_header") < _IP_HEADER),
            F.lit("malformed_ipv4"),
        )
        .when(F.col("_length") > F.col("_total"), F.lit("truncated"))
        .when(F.col("_fragment") != 0, F.lit("fragmented"))
        .when(~F.col("protocol").isin(ICMP, TCP, UDP), F.lit("unsupported_protocol"))
        .when(
            (payload < needed) | ((F.col("protocol") == TCP) & (tcp_offset < _TCP_HEADER)),
            F.lit("malformed_transport"),
        )
    )

    def kept(value: Column) -> Column:
        return F.when(F.col("reason").isNull(), value)

    ports = F.col("protocol") != ICMP
    size = F.col("_length")
    if size_policy == SIZE_RELEASE_COMPATIBLE:
        size = F.when(F.col("protocol") == UDP, _uint(b, F.col("_header") + 4, 2)).otherwise(size)
    return (
        fields.withColumn("reason", computed_once(reason))
        .withColumns(
            {
                "source_address": kept(_address(b, 12)),
                "source_port": kept(
                    F.when(ports, _uint(b, F.col("_header"), 2)).otherwise(F.lit(0))
                ),
                "destination_address": kept(_address(b, 16)),
                "destination_port": kept(
                    F.when(ports, _uint(b, F.col("_header") + 2, 2)).otherwise(F.lit(0))
                ),
                "size": kept(size).cast("bigint"),
            }
        )
        .withColumn("protocol", kept(F.col("protocol")))
        .drop(raw, "_total", "_version", "_header", "_length", "_fragment")
    )


def strip_ethernet(rows: DataFrame, *, frame: str = "frame", raw: str = "raw") -> DataFrame:
    """Take the Ethernet header and any VLAN tags off a frame.

    Adds ``frame_status``: ``ipv4``, ``non_ipv4`` or ``truncated``.  Tags are
    followed to any depth; a frame can hold one per four bytes.
    """
    b = F.col(frame)
    total = F.coalesce(F.octet_length(b), F.lit(0))
    start = F.struct(_uint(b, 12, 2).alias("kind"), F.lit(_ETHERNET_HEADER).alias("offset"))
    depth = F.greatest(F.floor((total - _ETHERNET_HEADER) / _VLAN_TAG).cast("int"), F.lit(0)) + 1

    def peel(state: Column, _: Column) -> Column:
        tagged = state["kind"].isin(_VLAN, _PROVIDER_VLAN)
        fits = total >= state["offset"] + _VLAN_TAG
        return F.struct(
            F.when(tagged & fits, _uint(b, state["offset"] + 2, 2))
            .when(tagged, F.lit(-1))
            .otherwise(state["kind"])
            .alias("kind"),
            F.when(tagged & fits, state["offset"] + _VLAN_TAG)
            .otherwise(state["offset"])
            .alias("offset"),
        )

    tagged_first = _uint(b, 12, 2).isin(_VLAN, _PROVIDER_VLAN)
    peeled = F.when(
        tagged_first, F.aggregate(F.sequence(F.lit(1), depth), start, peel)
    ).otherwise(start)
    return (
        rows.withColumn("_link", peeled)
        .withColumn(
            "frame_status",
            F.when((total < _ETHERNET_HEADER) | (F.col("_link.kind") == -1), F.lit("truncated"))
            .when(F.col("_link.kind") == _IPV4, F.lit("ipv4"))
            .otherwise(F.lit("non_ipv4")),
        )
        .withColumn(
            raw,
            F.when(
                F.col("frame_status") == "ipv4",
                F.substring(b, F.col("_link.offset") + 1, total),
            ),
        )
        .drop("_link", frame)
    )


def decode_frames(
    rows: DataFrame, *, frame: str = "frame", size_policy: str = SIZE_RELEASE_COMPATIBLE
) -> DataFrame:
    """Decode Ethernet frames; ``status`` is decoded, non_ipv4 or invalid."""
    decoded = decode_ipv4(strip_ethernet(rows, frame=frame), size_policy=size_policy)
    status = (
        F.when(F.col("frame_status") == "non_ipv4", F.lit("non_ipv4"))
        .when(
            (F.col("frame_status") == "truncated") | F.col("reason").isNotNull(), F.lit("invalid")
        )
        .otherwise(F.lit("decoded"))
    )
    return decoded.withColumn("status", computed_once(status)).drop("frame_status")
