"""python -m sparkindex"""

import sys

from sparkindex.plans.facade import main

sys.exit(main())
