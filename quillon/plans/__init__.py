"""The registered queries: each operator on stand-in rows made from the driver's tables, with its SQL twin."""
