from faultline.functions.columns import *  # noqa: F401,F403
from faultline.functions.columns import __all__  # noqa: F401
