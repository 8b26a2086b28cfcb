"""Registered queries: each operator bound to the driver's tables, with its SQL oracle where there is one."""
