"""Run the command line with ``python -m barspan``."""

import sys

from barspan.cli import main

sys.exit(main())
