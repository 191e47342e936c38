"""Column builders: nothing here runs a job."""

from decafix.functions.bounded import between, components, decode, eq, error_bound, fixed, fraction_bits, gt, is_bounded, literal, lt, precision_of
from decafix.functions.planes import bit_length, gt_by_planes, eq_by_planes, kept_bits, plane, plane_count, reduced

__all__ = ["between", "bit_length", "components", "decode", "eq", "eq_by_planes", "error_bound", "fixed", "fraction_bits", "gt", "gt_by_planes", "is_bounded", "kept_bits", "literal", "lt", "plane", "plane_count", "precision_of", "reduced"]
