import sys

from lattice.cli import main

sys.exit(main())
