"""temploom: template mining on Spark DataFrames."""
from temploom.operators.mine import MineResult, mine
from temploom.operators.options import MinerOptions
from temploom.functions.masks import Mask

__all__ = ["Mask", "MineResult", "MinerOptions", "mine"]
