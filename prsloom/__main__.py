import sys

from prsloom.cli import main

sys.exit(main())
